"""Signed session tokens: ``base64url(payload).hmac``, as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mrz import let

# --- fixed values ---
CHALLENGES = ("LOOK_LEFT", "LOOK_RIGHT", "MOVE_CLOSER", "MOVE_AWAY", "BLINK", "SMILE")
PAYLOAD = "sid string, chn array<string>, exp long"
#: Title, instruction and icon of each challenge.
METADATA = {
    "LOOK_LEFT": ("Chapga qarang", "Boshingizni biroz chap tomonga buring", "👈"),
    "LOOK_RIGHT": ("O'ngga qarang", "Boshingizni biroz o'ng tomonga buring", "👉"),
    "MOVE_CLOSER": ("Yaqinroq keling", "Yuzingizni kameraga yaqinlashtiring", "🔍"),
    "MOVE_AWAY": ("Uzoqroq qiling", "Kameradan biroz uzoqlashing", "↔️"),
    "BLINK": ("Ko'zingizni yuming", "Ko'zingizni bir marta yumib oching", "😉"),
    "SMILE": ("Jilmaying", "Kameraga qarab samimiy jilmaying", "😊"),
}
# --- end of fixed values ---


def _pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer pads of the SHA-256 HMAC under the key SHA-256(secret)."""
    if not secret:
        raise ValueError("a signing secret must be configured")
    key = hashlib.sha256(secret.encode()).digest().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(message: Column, secret: str) -> Column:
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(secret))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def base64url(text: Column) -> Column:
    return F.translate(F.base64(text.cast("binary")), "+/=\r\n", "-_")


def choose(seed: Column, count: int) -> Column:
    """``count`` challenges (1 to 4) in an order drawn by a hash of the seed; moving closer and away exclude each other."""
    if not 1 <= count <= 4:
        raise ValueError("count must be from 1 to 4")
    drawn = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws("-", seed.cast("string"), F.lit(c)).cast("binary")).alias("r"), F.lit(c).alias("c")) for c in CHALLENGES]))
    names = F.transform(drawn, lambda x: x["c"])
    moves = F.filter(names, lambda c: c.startswith("MOVE"))
    return F.slice(F.filter(names, lambda c: ~c.startswith("MOVE") | (c == F.get(moves, 0))), 1, count)


def sign(session: Column, challenges: Column, expires: Column, secret: str) -> Column:
    payload = base64url(F.to_json(F.struct(session.alias("sid"), challenges.alias("chn"), expires.cast("long").alias("exp"))))
    return let(payload, lambda p: F.concat(p, F.lit("."), hmac_hex(p, secret)))


def verify(token: Column, now: Column, secret: str) -> Column:
    """struct<valid, reason, payload>: malformed, forged, expired or ok; time is an argument."""

    def read(t: Column) -> Column:
        body = F.substring_index(t, ".", 1)
        return F.struct(t.alias("token"), body.alias("body"), (hmac_hex(body, secret) != F.substring(t, F.instr(t, F.lit(".")) + 1, F.length(t))).alias("forged"))

    def told(r: Column) -> Column:
        text = F.translate(r["body"], "-_", "+/")
        padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
        payload = F.from_json(F.when(~r["forged"], F.try_to_binary(padded, F.lit("base64")).cast("string")), PAYLOAD)
        return F.struct(r["token"].alias("token"), r["forged"].alias("forged"), payload.alias("payload"))

    def judged(r: Column) -> Column:
        reason = F.when(r["token"].isNull() | ~r["token"].contains("."), "malformed").when(r["forged"], "forged").when(r["payload"].isNull(), "malformed").when(now > F.coalesce(r["payload"]["exp"], F.lit(0)), "expired").otherwise("ok")
        return F.struct(reason.alias("reason"), r["payload"].alias("payload"))

    ok = lambda r: r["reason"] == "ok"
    # each step is bound once: written out, the signature would stand in every branch of the verdict
    return let(token, lambda t: let(read(t), lambda r: let(told(r), lambda x: let(judged(x), lambda v: F.struct(ok(v).alias("valid"), v["reason"].alias("reason"), F.when(ok(v), v["payload"]).alias("payload"))))))


def metadata(challenges: Column) -> Column:
    """array<struct<id, title, instruction, icon>> of the challenges, in their order; unknown ones are left out."""
    known = F.create_map(*[x for c, told in METADATA.items() for x in (F.lit(c), F.struct(F.lit(c).alias("id"), *[F.lit(v).alias(n) for v, n in zip(told, ("title", "instruction", "icon"))]))])
    return F.filter(F.transform(challenges, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull())


def started(sessions: DataFrame, session: str, now: Column, secret: str, count: int = 2, ttl: int = 90) -> DataFrame:
    """session, token, expires_in_seconds, challenges_count, challenges of a new liveness session for each row; the draw is a hash of the session's name."""
    drawn = sessions.select(F.col(session), choose(F.col(session), count).alias("_drawn"))
    token = sign(F.col(session).cast("string"), F.col("_drawn"), now + ttl, secret)
    return drawn.select(session, token.alias("token"), F.lit(ttl).alias("expires_in_seconds"), F.size("_drawn").alias("challenges_count"), metadata(F.col("_drawn")).alias("challenges"))
