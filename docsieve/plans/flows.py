"""Queries that lead through several operators or keep a state along a key. ``flow_oracles`` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mrz, text, tokens
from ..operators import admission, cards, extract, forensics, fusion, matching, sessions
from ..sources import media, sinks
from . import fixtures as fx

#: Two records of each person and some repeated: letters read as digits, noise, shortened names, short dates, a placeholder number that every tenth has.
_NUMBER = "CASE WHEN k % 10 = 0 THEN 'AG0000000' ELSE concat(substr('GAEBG', k % 5 + 1, 1), substr('FGEG', k % 4 + 1, 1), lpad(concat(k, ''), 7, '0')) END"
RECORDS = {
    "first": {"id": "2 * k", "document_number": f"CASE WHEN k % 29 = 0 THEN NULL ELSE {_NUMBER} END", "birth_date": "CASE WHEN k % 31 = 0 THEN '' ELSE birth END", "surname": "surname", "first_name": "first_name"},
    "second": {
        "id": "2 * k + 1",
        "document_number": f"CASE WHEN k % 3 = 0 THEN concat(replace(substr({_NUMBER}, 1, 1), 'G', '6'), substr({_NUMBER}, 2)) WHEN k % 3 = 1 THEN concat(lower(substr({_NUMBER}, 1, 1)), replace(substr({_NUMBER}, 2, 1), 'G', '6'), '- ', translate(substr({_NUMBER}, 3), '015', 'OIS')) ELSE {_NUMBER} END",
        "birth_date": "CASE WHEN k % 7 = 0 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) WHEN k % 11 = 0 THEN dob WHEN k % 13 = 0 THEN concat(substr(birth, 1, 5), '07', substr(birth, 8)) ELSE birth END",
        "surname": "CASE WHEN k % 19 = 0 THEN 'BOSHQAYEV' WHEN k % 17 = 0 THEN substr(surname, 1, 3) ELSE replace(surname, 'K', 'Q') END",
        "first_name": "CASE WHEN k % 23 = 0 THEN NULL ELSE first_name END",
    },
}


def records(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    one, two = (df.selectExpr(*[f"{e} AS {n}" for n, e in fields.items()], "k") for fields in RECORDS.values())
    again = one.where("k % 4 = 0").withColumn("id", F.col("id") + 10_000_000)
    return one.unionByName(two).unionByName(again).drop("k")


def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.pairs(matching.profiles(records(spark, sf)))


def admission_leaky(spark: SparkSession, sf: str) -> DataFrame:
    """Four requests a day, two more at once."""
    df = fx.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return admission.admitted(df, "user_id", "ts", "event_id", lambda: admission.LeakyBucket(*LEAKY)).select("user_id", "event_id", "admitted")


def admission_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three admitted requests in any two days."""
    df = fx.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return admission.admitted(df, "user_id", "ts", "event_id", lambda: admission.SlidingLog(*LOG)).select("user_id", "event_id", "admitted")


#: Frames of a session in order, four each, with what is measured on them; every sixth doesn't decode.
FRAMES = {
    "decoded": "event_id % 6 <> 0",
    "found": "event_type <> 'error'",
    "area": "value",
    "center": "event_id * 37 % 640",
    "width": "640",
    "profile": "event_id % 5 = 0",
    "eyes": "event_id % 3",
    "smiles": "event_id % 2",
    "spoof_score": "event_id % 13 * 5.0E0",
}
NOW = 1_000


def liveness_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user's events; some tokens are forged, expired, or no tokens."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = fx.table(spark, sf, "events").withColumn("rn", F.row_number().over(order) - 1)
    df = df.withColumns({"part": F.floor(F.col("rn") / 4), "idx": F.col("rn") % 4}).withColumn("session", F.concat_ws("-", "user_id", "part"))
    frames = df.selectExpr("session", "idx", *[f"{e} AS {n}" for n, e in FRAMES.items()])
    seed = F.col("user_id") * 1000 + F.col("part")
    drawn = F.slice(tokens.choose(seed, 3), F.lit(1), (1 + F.col("part") % 3).cast("int"))
    token = tokens.sign(F.col("session"), drawn, NOW + 1 - F.when(seed % 17 == 0, 2).otherwise(0), SECRET)
    spoilt = F.when(seed % 19 == 0, F.lit("no token")).when(seed % 13 == 0, F.concat(token, F.lit("0"))).otherwise(token)
    each = df.select("session", "user_id", "part").distinct().select("session", spoilt.alias("token"))
    out = sessions.verify_sessions(each, frames, "session", "token", F.lit(NOW), SECRET)
    told = F.array_join(F.transform("challenges_verified", lambda c: F.concat_ws(" ", c["challenge_id"], c["passed"].cast("string"), F.format_number(c["confidence"], 1))), ",")
    return out.select("session", "success", "verdict", "is_live", "liveness_score", "reason", told.alias("challenges"))


def challenge_metadata(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.spread(fx.table(spark, sf, "events").select("event_id")).select(F.concat_ws("-", F.lit("s"), "event_id").alias("session"))
    out = tokens.started(df, "session", F.lit(NOW), SECRET)
    one = F.transform("challenges", lambda c: F.concat_ws("|", c["id"], c["title"], c["instruction"], c["icon"]))
    return out.select("session", F.col("expires_in_seconds").cast("long").alias("expires_in_seconds"), F.col("challenges_count").cast("long").alias("challenges_count"), F.array_join(one, ";").alias("challenges"))


#: What a search of the zone reads in a part of an image, by (k + 2 * place) % 6: nothing; the zone in the second reading alone; in the first; without its name line.
PARTS = 5
# A Cyrillic letter stands for C, which counts as noise in the zone.
_GOOD = "concat('x\n', replace(l1, 'C', 'С'), '\n', l2, '\n', l3, '\n')"
FIRST_READING = f"CASE WHEN (k + 2 * part) % 6 = 2 THEN {_GOOD} WHEN (k + 2 * part) % 6 = 3 THEN concat(replace(l1, 'C', 'С'), '\n', l2, '\n<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n') WHEN (k + 2 * part) % 6 = 4 THEN l3 ELSE 'noise' END"
SECOND_READING = f"CASE WHEN (k + 2 * part) % 6 IN (1, 5) THEN {_GOOD} ELSE '' END"


def zone_search(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).where("k % 7 <> 0 OR (k + 2 * part) % 6 IN (0, 3, 4)")
    df = df.selectExpr("k", "part", f"{FIRST_READING} AS first", f"{SECOND_READING} AS second")
    out = cards.zone_search(df, ["k"], "part", "first", "second", AS_OF_YEAR)
    return out.select("k", "part", "score", F.col("mrz.document_number").alias("document_number"), F.col("mrz.jshshir").alias("jshshir"), F.col("mrz.surname").alias("surname"))


AS_OF_YEAR = 2026
#: The texts of both sides: another document, a birth a day off, another expiry, an upload in reverse, by the key.
SIDES = {
    "fdoc": "CASE WHEN k % 11 = 0 THEN concat('AF', lpad(concat(k + 1234567, ''), 7, '0')) ELSE doc END",
    "fbirth": "CASE WHEN k % 7 = 0 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) ELSE birth END",
    "fexpiry": "CASE WHEN k % 17 = 0 THEN concat('2040', substr(expiry, 5)) ELSE expiry END",
}
_DATE = "substr({0}, 9, 2), '.', substr({0}, 6, 2), '.', substr({0}, 1, 4)"
FRONT_TEXT = f"concat('O''ZBEKISTON RESPUBLIKASI\nSHAXS GUVOHNOMASI\nFamiliyasi / Surname\n', surname, '\nIsmi / Given names\n', first_name, '\n', CASE WHEN k % 3 = 0 THEN '' ELSE 'Otasining ismi\n' END, 'KARIMOVICH\nTug''ilgan sanasi\n', {_DATE.format('fbirth')}, '\nJinsi\n', upper(gender), '\nBerilgan sanasi\n', substr(expiry, 9, 2), '.', substr(expiry, 6, 2), '.2020\nAmal qilish muddati\n', {_DATE.format('fexpiry')}, '\nKarta raqami\n', fdoc, '\n')"
BACK_TEXT = "concat('Tug''ilgan joyi\nPOP TUMANI\nBerilgan joyi\n12345\n', replace(l1, 'C', 'С'), '\n', l2, '\n', l3, '\n')"


def card_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).selectExpr("*", *[f"{e} AS {n}" for n, e in SIDES.items()])
    upload = F.col("k") % 5 == 0
    front = F.struct(upload.cast("int").alias("upload"), F.expr(FRONT_TEXT).alias("text"), F.lit(True).alias("face_detected"))
    back = F.struct((~upload).cast("int").alias("upload"), F.expr(BACK_TEXT).alias("text"), F.lit(False).alias("face_detected"))
    return df.select("key", F.explode(F.array(front, back)).alias("s")).select("key", "s.*")


def card_verification(spark: SparkSession, sf: str) -> DataFrame:
    """From the recognised texts of two sides to the merged profile and its verdict."""
    m = F.col("merged")
    p = m["citizen_profile"]
    fields = [p[n].alias(n) for n in ("document_number", "personal_number", "surname", "full_name", "date_of_birth", "date_of_expiry", "place_of_birth", "nationality")]
    out = cards.verified_cards(card_texts(spark, sf), ["key"], "text", AS_OF_YEAR, fx.session_tasks(spark, sf))
    return out.select("key", m["overall_status"].alias("overall_status"), m["match_score"].alias("match_score"), m["different_cards_detected"].alias("different_cards"), m["auto_swapped"].alias("auto_swapped"), m["confidence"].alias("confidence"), F.array_join(m["fraud_alerts"], ",").alias("alerts"), *fields)


#: Pixels of a small raster (blue, green, red at x, y) from a key: waves, and bright fields of one, two, or two that touch at a corner.
SIDE = 16
_WAVE = "(k * 7 + x * x * (k % 5 + 1) + y * 13 * (k % 3 + 1))"
_BRIGHT = "CASE k % 4 WHEN 0 THEN x < 11 AND y < 10 WHEN 1 THEN x < 6 OR x >= 10 WHEN 2 THEN (x < 9 AND y < 9) OR (x >= 9 AND y >= 9) ELSE false END"
PIXEL = {c: f"CASE WHEN {_BRIGHT} THEN 250 + (x + y + {i}) % 5 ELSE {_WAVE} * {m} % {256 - 8 * i} END" for i, (c, m) in enumerate({"b": 1, "g": 3, "r": 5}.items())}


def _pixels(keys: np.ndarray) -> np.ndarray:
    """uint8[n, SIDE, SIDE, 3]: what PIXEL says, for an array of keys at once."""
    k = keys.astype(np.int64)[:, None, None]
    y, x = np.ogrid[:SIDE, :SIDE]
    wave = k * 7 + x * x * (k % 5 + 1) + y * 13 * (k % 3 + 1)
    fields = ((x < 11) & (y < 10), (x < 6) | (x >= 10), ((x < 9) & (y < 9)) | ((x >= 9) & (y >= 9)))
    bright = ((k % 4 == 0) & fields[0]) | ((k % 4 == 1) & fields[1]) | ((k % 4 == 2) & fields[2])
    return np.stack([np.where(bright, 250 + (x + y + i) % 5, wave * m % (256 - 8 * i)) for i, m in enumerate((1, 3, 5))], axis=-1).astype(np.uint8)


def rasters(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    """k and an image struct of the image source's kind for each row of a table."""

    @F.pandas_udf("binary")
    def data(keys: pd.Series) -> pd.Series:
        made = [_pixels(keys.to_numpy()[i : i + 500]) for i in range(0, len(keys), 500)]
        return pd.Series([x.tobytes() for part in made for x in part], index=keys.index, dtype=object)

    df = fx.spread(fx.table(spark, sf, table).selectExpr(f"{key} AS k")).select("k", data("k").alias("data"))
    return df.selectExpr("k", f"named_struct('origin', '', 'height', {SIDE}, 'width', {SIDE}, 'nChannels', 3, 'mode', 16, 'data', data) AS image")


def raster_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = forensics.full_forensics(rasters(spark, sf, "part", "p_partkey"))
    q, v = F.col("forensics.quality.features"), F.col("forensics.quality.verdict")
    return out.select("k", F.col("forensics.success").alias("success"), q["variance"].alias("variance"), q["glare"].alias("glare"), q["brightness"].alias("brightness"), F.round(q["contrast"], 3).alias("contrast"), v["score"].alias("score"), v["is_blurry"].alias("is_blurry"), v["has_glare"].alias("has_glare"), v["brightness_level"].alias("brightness_level"))


def raster_spoofing(spark: SparkSession, sf: str) -> DataFrame:
    out = forensics.full_forensics(rasters(spark, sf, "supplier", "s_suppkey"))
    f, v = F.col("forensics.spoofing.features"), F.col("forensics.spoofing.verdict")
    return out.select("k", f["glare_spots"].cast("long").alias("glare_spots"), F.round(f["cr_std"], 3).alias("cr_std"), F.round(f["cb_std"], 3).alias("cb_std"), v["score"].alias("score"), v["is_spoof"].alias("is_spoof"), F.array_join(v["flags"], ",").alias("flags"))


#: Texts whose number is found in different ways, by k % 8: spaced, with letters for digits, after a label alone, nine digits, behind a word's prefix, A0 for AD, Cyrillic letters, none.
NUMBERED = """CASE k % 8 WHEN 0 THEN concat('abc ', substr(doc, 1, 2), '  ', substr(doc, 3), ' def') WHEN 1 THEN concat('x AB', translate(substr(doc, 3), '150', 'ISO'), ' y') WHEN 2 THEN concat('KARTA RAQAMI: QX', translate(substr(doc, 3), '58', 'SB'), ' 123456789')
WHEN 3 THEN concat('no. ', lpad(concat(k, ''), 9, '1'), ' and 7') WHEN 4 THEN concat('UZ', substr(doc, 3), ' SH7654321 ', doc) WHEN 5 THEN concat('A0', substr(doc, 3), '.') WHEN 6 THEN concat('АВ', substr(doc, 3), ' ') ELSE 'none 12345678' END"""
#: Texts with personal numbers by k % 6: labelled and parted, an implausible labelled one before another, parted by dashes, a second plausible one, implausible alone, none.
PERSONAL = """CASE k % 6 WHEN 0 THEN concat('12345678901234 Shaxsiy raqami: ', substr(pinfl, 1, 1), ' ', substr(pinfl, 2, 6), ' ', substr(pinfl, 8)) WHEN 1 THEN concat('personal number 39906901234567, ', pinfl) WHEN 2 THEN concat('id ', substr(pinfl, 1, 7), '-', substr(pinfl, 8), ' ok')
WHEN 3 THEN concat('39906901234567 ', pinfl, ' 31506901234567') WHEN 4 THEN '39906901234567' ELSE 'none' END"""
#: Name fields of a passport's zone with digits, fillers and noise letters, by k % 5.
TOKEN = "CASE k % 5 WHEN 0 THEN concat('12', surname, 'K<<<K<K') WHEN 1 THEN concat('P ', surname, 'A<<') WHEN 2 THEN concat(surname, 'SKC<S') WHEN 3 THEN concat('ALIS<', substr(surname, 1, 4), '<E') ELSE concat(' ', surname, '<<', first_name) END"


def docnum_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("text", F.expr(NUMBERED))
    return df.select("k", text.document_number(F.col("text")).alias("document_number"))


def pinfl_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("text", F.expr(PERSONAL))
    return df.select("k", text.personal_number(F.col("text")).alias("jshshir"))


def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("token", F.expr(TOKEN))
    return df.select("k", mrz.name_token(F.col("token"), True).alias("surname"), mrz.name_token(F.col("token"), False).alias("first_name"))


def shown_record(spark: SparkSession, sf: str) -> DataFrame:
    """Of the records that a document has, the one to show."""
    some = lambda n, part: F.when(F.col("k") % n == 0, F.struct(F.lit(part).alias("part"), F.concat_ws(" ", "surname", F.lit(part)).alias("full_name")))
    df = fx.identities(spark, sf).withColumn("r", fusion.precedence(some(2, "profile"), some(3, "fields"), some(5, "merged"), some(7, "page")))
    return df.select("k", "r.part", "r.full_name")


#: Uploads that should be PDFs: their path, first bytes in hex, and length.
UPLOAD = {"path": "concat('in/', k, CASE k % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '' END)", "head": "CASE WHEN k % 3 = 0 THEN '255044462D312E34' WHEN k % 3 = 1 THEN '2550444620' ELSE '' END", "size": "CASE WHEN k % 7 = 0 THEN 30000000 ELSE k * 1000 END"}
#: Words and places as they are read: marks at both ends, Cyrillic letters, apostrophes of four kinds, names of places.
WORDS = {"word": "concat(CASE k % 3 WHEN 0 THEN '--1' WHEN 1 THEN '(' ELSE '' END, surname, CASE k % 2 WHEN 0 THEN ' 7.' ELSE ')' END)", "cyrillic": "concat(translate(surname, 'ABEKM', 'АВЕКМ'), 'ЗоЬ')", "quoted": "concat('O', CASE k % 4 WHEN 0 THEN 'ʻ' WHEN 1 THEN 'ʼ' WHEN 2 THEN '`' ELSE chr(39) END, surname)", "place": "concat(CASE k % 4 WHEN 0 THEN 'РОР' WHEN 1 THEN 'NAMANGAN  REGION' WHEN 2 THEN 'ХUSТ' ELSE 'pop tomamt' END, CASE k % 3 WHEN 0 THEN ' ТУМАНИ' WHEN 1 THEN ' шаҳри' ELSE '' END)"}


def pdf_uploads(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).selectExpr("k", *[f"{e} AS {n}" for n, e in UPLOAD.items()])
    return df.select("k", "path", media.pdf_rejection(F.col("path"), F.unhex("head"), F.col("size")).alias("rejection"))


def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as JSON, and their data as a URI."""
    df = fx.identities(spark, sf).selectExpr("k", "surname", "k % 3 <> 0 AS success", "CASE WHEN k % 5 = 0 THEN 'invalid' END AS problem", "concat('say \"', doc, '\"') AS quoted")
    return sinks.responses(df, "success", "problem").withColumn("uri", sinks.data_uri(F.encode("body", "utf-8"), "application/json")).select(F.get_json_object("body", "$.k").cast("long").alias("k"), F.col("status_code").cast("long").alias("status_code"), "body", "uri")


def word_folding(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).selectExpr("k", *[f"{e} AS {n}" for n, e in WORDS.items()])
    return df.select("k", text.clean_word(F.col("word")).alias("word"), text.fold(F.col("cyrillic")).alias("folded"), text.no_apostrophes(F.col("quoted")).alias("plain"), extract.toponym(F.col("place")).alias("place"))


#: The signing secret of these queries; a deployment configures its own.
SECRET = "query-fixture"
DAY = 86_400_000
LEAKY, LOG = (4, DAY, 2), (3, 2 * DAY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (fuzzy_pairs, admission_leaky, admission_log, liveness_verify, zone_search, card_verification, raster_quality, raster_spoofing, challenge_metadata, docnum_fallbacks, pinfl_fallbacks, name_tokens, shown_record, pdf_uploads, json_export, word_folding)
    return {f.__name__: f for f in found}
