"""Liveness sessions from what is submitted: a signed token and frames, some of which don't decode.

The token's challenges stand beside the frames by rank: frames that don't decode are dropped, so every later one moves up. Only as many frames as
a token can ask for are kept of a session, by a limit that is applied before the shuffle, so a session with any number of frames stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, tokens
from .liveness import composite

#: The baseline and a frame for each challenge.
MOST_FRAMES = len(tokens.CHALLENGES) + 1
#: What is measured on a frame: a face is there, its area, the place of its middle, the frame's width, a profile, open eyes, smiles, the spoof score.
MEASURES = ("found", "area", "center", "width", "profile", "eyes", "smiles", "spoof_score")


def submitted(frames: DataFrame, session: str, idx: str = "idx", decoded: str = "decoded") -> DataFrame:
    """(session, n_frames, n_decoded, frames): counts of all frames, and the first decoded ones in order."""
    counts = frames.groupBy(session).agg(F.count("*").alias("n_frames"), F.count_if(F.coalesce(F.col(decoded), F.lit(False))).alias("n_decoded"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(idx, *MEASURES))
    first = frames.where(F.col(decoded)).select(session, idx, *MEASURES).withColumn("_rank", place).where(F.col("_rank") <= MOST_FRAMES)
    kept = first.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*MEASURES).alias("f")))), lambda x: x["f"]).alias("frames"))
    return counts.join(kept, session, "left")


def steps(challenges: Column, frames: Column, strict_blink: bool = False) -> Column:
    """array<struct<challenge_id, passed, confidence>>: each challenge on its frame, beside the baseline."""
    base = F.get(frames, 0)

    def step(kind: Column, i: Column) -> Column:
        f = F.get(frames, i + 1)
        both = F.coalesce(base["found"] & f["found"], F.lit(False))
        ratio = F.when(both, f["area"] / (base["area"] + 1e-4))
        shift = F.when(both, (f["center"] - base["center"]) / f["width"])
        r = scores.challenge(kind, base["found"], f["found"], ratio, shift, f["profile"], f["eyes"], f["smiles"], strict_blink)
        return F.struct(kind.alias("challenge_id"), r["passed"].alias("passed"), r["confidence"].alias("confidence"))

    return F.transform(challenges, step)


def verify_sessions(sessions: DataFrame, frames: DataFrame, session: str, token: str, now: Column, secret: str, strict_blink: bool = False) -> DataFrame:
    """(session, success, verdict, is_live, liveness_score, reason, challenges_verified) of every row of sessions (session, token).

    The first that holds decides: a token that is malformed, forged or expired; fewer frames than it asks for; fewer that decode; a baseline that looks
    like a picture of a face; then the challenges. A session without frames has none of them. A repeated session is judged once for each token.
    """
    seen = submitted(frames, session)
    df = sessions.select(session, F.col(token).alias("_token")).join(seen, session, "left")
    df = df.withColumn("_v", tokens.verify(F.col("_token"), now, secret))
    asked = F.coalesce(F.col("_v.payload.chn"), F.array().cast("array<string>"))
    valid, need = F.col("_v.valid"), F.size(asked) + 1
    few, bad = F.coalesce("n_frames", F.lit(0)) < need, F.coalesce("n_decoded", F.lit(0)) < need
    df = df.withColumn("_steps", F.when(valid & ~few & ~bad, steps(asked, F.col("frames"), strict_blink)))
    spoof = F.get("frames", F.lit(0))["spoof_score"]
    spoofed = spoof >= 50.0
    active = F.aggregate("_steps", F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + x["confidence"].cast("decimal(9,2)")).cast("decimal(38,2)"))
    passed = F.forall("_steps", lambda x: x["passed"])
    score = composite(active, F.size("_steps").cast("long"), spoof)
    live = passed & (score >= 65.0)
    verdict = F.when(~valid, "INVALID_TOKEN").when(few, "INSUFFICIENT_FRAMES").when(bad, "DECODE_ERROR").when(spoofed, "SPOOF_ATTACK_DETECTED").when(live, "LIVE_AUTHENTIC").otherwise("CHALLENGE_FAILED")
    df = df.withColumns({"_verdict": verdict, "_score": score})
    early = F.col("_verdict").isin("INVALID_TOKEN", "INSUFFICIENT_FRAMES", "DECODE_ERROR")
    points = F.when(early, 0.0).when(F.col("_verdict") == "SPOOF_ATTACK_DETECTED", F.bround(100.0 - spoof, 1)).otherwise(F.col("_score"))
    none = F.array().cast("array<struct<challenge_id:string,passed:boolean,confidence:double>>")
    shown = F.when(F.col("_verdict").isin("LIVE_AUTHENTIC", "CHALLENGE_FAILED"), F.col("_steps")).otherwise(none)
    return df.select(session, (~early).alias("success"), F.col("_verdict").alias("verdict"), (F.col("_verdict") == "LIVE_AUTHENTIC").alias("is_live"), points.alias("liveness_score"), F.col("_v.reason").alias("reason"), shown.alias("challenges_verified"))
