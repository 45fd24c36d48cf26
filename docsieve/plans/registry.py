"""Queries of the document-verification operators. Each reads its tables whole; ``oracles`` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import linkage as match
from ..functions import mrz, scores, text, tokens
from ..operators import extract, folds, fusion, liveness, zone
from ..operators import linkage as cards
from ..sources import media, sinks
from . import fixtures as fx
from . import flow_oracles, flows, oracles

FLAGSHIP = "two_sided_merge"
AS_OF_YEAR = 2026
#: The signing secret of the token queries; a deployment configures its own.
QUERY_SECRET = "query-fixture"


def icao_check_digit(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    return df.select("k", "doc", mrz.check_digit(F.col("doc")).alias("doc_digit"), mrz.check_digit(F.col("dob")).alias("dob_digit"))


def icao_verify(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    told = F.when(F.col("k") % 5 == 0, F.lit("x")).when(F.col("k") % 5 == 1, F.lit("3")).otherwise(mrz.check_digit(F.col("doc")))
    return df.select("k", mrz.verify(F.col("doc"), told).alias("valid"))


def doc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("noisy", F.concat(F.translate(F.substring("doc", 1, 2), "ABDE", "48DE"), F.translate(F.substring("doc", 3, 7), "0158", "OISB")))
    return df.select("k", mrz.normalize_nine(F.col("noisy")).alias("nine"), mrz.normalize_document(F.concat(F.substring("noisy", 1, 2), F.lit("- "), F.lower(F.substring("noisy", 3, 7)))).alias("document"))


def doc_match(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).withColumn("bad", F.expr(fx.CORRUPT))
    return df.select("k", match.documents_match(F.col("doc"), F.col("bad")).alias("matches"))


def mrz_autocorrect(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).select("k", mrz.auto_correct(F.expr(fx.CORRUPT), mrz.check_digit(F.col("doc"))).alias("r"))
    return df.select("k", F.col("r.value").alias("value"), F.col("r.corrected").alias("corrected"))


def pinfl_check(spark: SparkSession, sf: str) -> DataFrame:
    return fx.identities(spark, sf).select("k", mrz.pinfl_digit(F.when(F.col("k") % 10 == 0, F.lit("12x")).otherwise(F.col("p13"))).cast("long").alias("digit"))


def pinfl_autocorrect(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.expr("CASE WHEN k % 3 = 0 THEN concat(substr(pinfl, 1, 12), translate(substr(pinfl, 13, 1), '0123456789', '6478139250'), substr(pinfl, 14)) ELSE pinfl END")
    df = fx.identities(spark, sf).select("k", mrz.correct_pinfl(bad).alias("r"))
    return df.select("k", F.col("r.value").alias("value"), F.col("r.corrected").alias("corrected"))


def _crossed(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    birth = F.expr("CASE WHEN k % 7 = 0 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) WHEN k % 7 = 1 THEN NULL ELSE birth END")
    gender = F.expr("CASE WHEN k % 11 = 0 THEN 'Erkak' WHEN k % 11 = 1 THEN NULL ELSE gender END")
    pin = F.expr("CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN '123' WHEN k % 13 = 2 THEN concat('9', substr(pinfl, 2)) WHEN k % 13 = 3 THEN concat(substr(pinfl, 1, 1), '45', substr(pinfl, 4)) ELSE pinfl END")
    return df.select("k", zone.cross_check(pin, birth, gender).alias("r"))


def pinfl_cross_check(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    return _crossed(spark, sf).select("k", r["status"].alias("status"), r["is_valid"].alias("is_valid"), r["birth_date_matches"].alias("birth_ok"), r["gender_matches"].alias("gender_ok"), r["pinfl_parsed"]["birth_date"].alias("own_birth"), F.array_join(r["alerts"], ",").alias("alerts"))


def mrz_dates(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "orders").select("o_orderkey", F.expr("lpad(concat(o_orderkey * 37 % 1000000, ''), 6, '0')").alias("d"))
    return df.select("o_orderkey", mrz.birth_date(F.col("d"), AS_OF_YEAR).alias("birth"), mrz.birth_date(F.col("d"), AS_OF_YEAR, F.when(F.col("o_orderkey") % 2 == 0, 1900).otherwise(2000)).alias("birth_century"), mrz.expiry_date(F.col("d")).alias("expiry"))


def date_digits(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select("p_partkey", mrz.clean_date_digits(F.col("p_name")).alias("digits"))


def _noisy_zone(spark: SparkSession, sf: str) -> DataFrame:
    return fx.identities(spark, sf).withColumn("raw", F.concat(F.lit("x\n "), F.translate("l1", "<", "«"), F.lit(" \nМ"), F.lower("l2"), F.lit("\n"), F.regexp_replace("l3", "<", " ("), F.lit("\n"), "p2"))


def mrz_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _noisy_zone(spark, sf).select("k", F.array_join(mrz.clean_lines(F.col("raw")), "\n").alias("lines"))


def mrz_score(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    some = lambda n, c: F.when(F.col("k") % n != 0, F.col(c))
    record = F.struct((F.col("k") % 17 != 0).alias("mrz_detected"), F.when(F.col("k") % 3 == 0, F.lit("A1")).otherwise(F.col("doc")).alias("document_number"), some(5, "pinfl").alias("jshshir"), some(7, "birth").alias("birth_date"), some(11, "expiry").alias("expiry_date"), some(13, "surname").alias("surname"), F.col("first_name").alias("first_name"))
    return df.select("k", mrz.score_candidate(record).cast("long").alias("score"))


def mrz_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ratio"), (F.col("l_partkey") * 7 % 131).cast("int").alias("score"))
    return liveness.best_candidate(df, ["l_orderkey"], "ratio", "score")


def _records(spark: SparkSession, sf: str, lines: str) -> DataFrame:
    return zone.parse(fx.identities(spark, sf), lines, AS_OF_YEAR)


def mrz_parse_td1(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, "lines").select("k", "mrz.*")


def mrz_parse_td3(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, "passport").select("k", "mrz.*")


def mrz_parse_noisy(spark: SparkSession, sf: str) -> DataFrame:
    df = _noisy_zone(spark, sf).withColumn("cleaned", mrz.clean_lines(F.col("raw")))
    return zone.parse(df, "cleaned", AS_OF_YEAR).select("k", "mrz.*")


def pinfl_overlap_search(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf).select("k", mrz.rightmost_pinfl(F.concat("pinfl", F.substring("pinfl", 2, 9), F.lit("<"))).alias("r"))
    return df.select("k", F.col("r.at").cast("long").alias("at"), F.col("r.value").alias("value"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    df = _records(spark, sf, "lines")
    spoilt = F.expr("CASE WHEN k % 4 = 0 THEN concat(substr(l2, 1, 6), (CAST(substr(l2, 7, 1) AS int) + 5) % 10, substr(l2, 8)) ELSE l2 END")
    return zone.checksums(df.withColumn("lines", F.array(F.col("l1"), spoilt, F.col("l3"))))


def mrz_checksums(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("mrz_checksums")
    return _checked(spark, sf).select("k", *[c[n].alias(n) for n in ("has_mrz", "document_number_valid", "expiry_date_valid", "composite_valid")], F.coalesce(c["birth_date_valid"], F.lit(False)).alias("birth_date_valid"), c["all_passed"].alias("all_passed"))


def mrz_checksums_td3(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("mrz_checksums")
    df = zone.checksums(_records(spark, sf, "passport"), "passport")
    return df.select("k", *[c[n].alias(n) for n in ("has_mrz", "document_number_valid", "birth_date_valid", "expiry_date_valid", "composite_valid", "all_passed")], F.size(c["auto_corrections_applied"]).cast("long").alias("corrections"))


def verification_report(spark: SparkSession, sf: str) -> DataFrame:
    df = _checked(spark, sf)
    birth = F.expr("CASE WHEN k % 3 = 0 THEN '1931-05-05' ELSE birth END")
    df = df.withColumn("cross", zone.cross_check(F.col("pinfl"), birth, F.col("gender")))
    r = zone.report(F.col("mrz_checksums"), F.col("pinfl"), F.col("cross"))
    return df.select("k", r.alias("r")).select("k", "r.overall_status", "r.is_authentic", F.array_join("r.fraud_alerts", ",").alias("alerts"))


def extract_docnum(spark: SparkSession, sf: str) -> DataFrame:
    return fx.label_texts(spark, sf).select("k", text.document_number(F.col("text")).alias("document_number"))


def extract_pinfl(spark: SparkSession, sf: str) -> DataFrame:
    return fx.label_texts(spark, sf).select("k", text.personal_number(F.col("text")).alias("jshshir"))


def extract_dates(spark: SparkSession, sf: str) -> DataFrame:
    return extract.dates(fx.label_texts(spark, sf)).select("k", "dates.*")


def extract_names(spark: SparkSession, sf: str) -> DataFrame:
    return extract.names(fx.label_texts(spark, sf)).select("k", "names.*")


def extract_other(spark: SparkSession, sf: str) -> DataFrame:
    return extract.others(fx.label_texts(spark, sf)).select("k", "other.*")


def extract_negative(spark: SparkSession, sf: str) -> DataFrame:
    df = extract.dates(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return df.select(F.count("*").alias("documents"), F.count(F.when(text.document_number(F.col("text")).rlike("^[A-Z]{2}"), 1)).alias("numbers"), F.count("dates.birth_date").alias("births"))


def translit_match(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    body, zone_ = F.expr("concat('O''', surname, 'XON')"), F.expr("concat('U', surname, CASE WHEN k % 3 = 0 THEN 'XON' WHEN k % 3 = 1 THEN 'KHON' ELSE 'GON' END)")
    return df.select("k", text.transliterated(body, zone_).alias("same"))


def strong_first_name(spark: SparkSession, sf: str) -> DataFrame:
    return fx.identities(spark, sf).select("k", text.strong_first_name(F.expr("CASE WHEN k % 3 = 0 THEN first_name WHEN k % 3 = 1 THEN 'CENTRE' ELSE substr(first_name, 1, 4) END")).alias("strong"))


def patronymic_repair(spark: SparkSession, sf: str) -> DataFrame:
    return fx.identities(spark, sf).select("k", text.repair_patronymic(F.expr("concat(lower(surname), CASE WHEN k % 4 = 0 THEN 'ish' WHEN k % 4 = 1 THEN 'ic' WHEN k % 4 = 2 THEN 'na' ELSE 'ha' END)")).alias("patronymic"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.identities(spark, sf)
    null = F.lit(None).cast("string")
    some = lambda n, c: F.when(F.col("k") % n != 0, F.col(c))
    fields = F.struct(some(3, "doc").alias("document_number"), null.alias("jshshir"), some(4, "surname").alias("surname"), some(5, "first_name").alias("first_name"), F.lit("KARIMOVICH").alias("patronymic"), null.alias("birth_date"), null.alias("expiry_date"), null.alias("issue_date"), null.alias("gender"), null.alias("nationality"), null.alias("birth_place"), null.alias("issuing_authority"))
    m = F.struct(F.col("doc").alias("document_number"), some(6, "pinfl").alias("jshshir"), F.col("surname").alias("surname"), F.col("first_name").alias("first_name"), null.alias("birth_date"), F.col("expiry").alias("expiry_date"), null.alias("gender"), F.lit("O'zbekiston").alias("nationality"))
    return df.withColumn("f", fusion.fuse(fields, m, F.lit("")))


def fuse_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("k", *[F.col(f"f.{n}") for n in ("document_number", "jshshir", "surname", "first_name", "birth_date", "expiry_date", "gender", "nationality")])


def derive_gender_birth(spark: SparkSession, sf: str) -> DataFrame:
    pat = F.expr("CASE WHEN k % 3 = 0 THEN 'ALI QIZI' WHEN k % 3 = 1 THEN 'KARIMOVICH' ELSE NULL END")
    return fx.identities(spark, sf).select("k", fusion.gender_from(pat, F.col("pinfl")).alias("derived_gender"), fusion.birth_from(F.col("pinfl")).alias("derived_birth"))


def side_classify(spark: SparkSession, sf: str) -> DataFrame:
    form = F.expr(f"CASE WHEN k % 6 = 0 THEN '{zone.TD1}' WHEN k % 6 = 1 THEN '{zone.TD3}' ELSE NULL END")
    corpus = F.expr("CASE WHEN k % 6 = 2 THEN 'O''ZBEKISTON RESPUBLIKASI shaxsiy imzo' WHEN k % 12 = 0 THEN 'Familiyasi' ELSE '' END")
    some = lambda n, c: F.when(F.col("k") % 6 == n, F.col(c))
    null = F.lit(None).cast("string")
    return fx.identities(spark, sf).select("k", fusion.side(form, corpus, some(3, "doc"), some(4, "surname"), null, null).alias("side"))


def field_confidence(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda n, c: F.when(F.col("k") % n != 0, F.col(c)).alias
    fields = F.struct(some(2, "doc")("document_number"), some(3, "surname")("surname"), some(5, "first_name")("first_name"), some(7, "birth")("birth_date"), some(4, "pinfl")("jshshir"))
    return fx.identities(spark, sf).select("k", fusion.field_confidence(fields, F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "PASS").otherwise("WARN")).alias("confidence"))


def profile_build(spark: SparkSession, sf: str) -> DataFrame:
    df = _fused(spark, sf).withColumn("p", fusion.profile(F.col("f"), F.lit("ID_CARD")))
    return df.select("k", "p.full_name", "p.document_number", "p.date_of_birth", "p.nationality", "p.is_valid_pair")


def _client(spark: SparkSession, sf: str) -> DataFrame:
    return fx.identities(spark, sf).select("k", F.when(F.col("k") % 2 == 0, F.col("surname")).otherwise(F.lit("null")).alias("surname"), "first_name", F.lit("KARIM QIZI").alias("patronymic"), F.when(F.col("k") % 3 == 0, F.col("pinfl")).alias("jshshir"), F.col("doc").alias("doc_num"), F.when(F.col("k") % 5 == 0, F.col("birth")).alias("birth_date"))


def normalize_profile(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.normalised(_client(spark, sf)).select("k", "full_name", "surname", "personal_number", "document_number", "date_of_birth", "gender", "nationality")


def export_long(spark: SparkSession, sf: str) -> DataFrame:
    df = fusion.long_fields(fusion.normalised(_client(spark, sf)), "k")
    return df.select("k", "field", "value", sinks.csv_line(F.col("field"), F.col("value")).alias("csv"))


def copy_text(spark: SparkSession, sf: str) -> DataFrame:
    df = fusion.normalised(_client(spark, sf))
    return df.select("k", fusion.labelled_text(df).alias("labelled"), fusion.compact_text(F.col("full_name"), F.col("personal_number")).alias("compact"))


def client_validate(spark: SparkSession, sf: str) -> DataFrame:
    birth = F.expr("CASE WHEN k % 4 = 0 THEN '1900-01-01' WHEN k % 4 = 1 THEN NULL ELSE birth END")
    r = fusion.client_check(F.when(F.col("k") % 9 != 0, F.col("pinfl")), birth, F.expr("CASE WHEN k % 5 = 0 THEN 'male' ELSE gender END"), F.col("k") % 2 == 0)
    return fx.identities(spark, sf).select("k", r.alias("r")).select("k", "r.*")


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return cards.merge(cards.pair_up(fx.sides(spark, sf), ["key"], tasks=fx.session_tasks(spark, sf)))


def two_sided_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("merged")
    p = m["citizen_profile"]
    fields = [p[n].alias(n) for n in ("document_number", "personal_number", "surname", "full_name", "date_of_birth", "date_of_expiry", "place_of_birth", "nationality")]
    return _merged(spark, sf).select("key", m["overall_status"].alias("overall_status"), m["match_score"].alias("match_score"), m["different_cards_detected"].alias("different_cards"), m["auto_swapped"].alias("auto_swapped"), m["confidence"].alias("confidence"), F.array_join(m["fraud_alerts"], ",").alias("alerts"), *fields)


def merge_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).groupBy(F.col("merged.overall_status").alias("overall_status")).agg(F.count("*").alias("n"))


def auto_swap(spark: SparkSession, sf: str) -> DataFrame:
    return cards.pair_up(fx.sides(spark, sf), ["key"], tasks=fx.session_tasks(spark, sf)).select("key", cards.swapped(F.col("a"), F.col("b")).alias("swapped"))


def date_match(spark: SparkSession, sf: str) -> DataFrame:
    other = F.expr("CASE WHEN k % 6 = 0 THEN birth WHEN k % 6 = 1 THEN concat(substr(birth, 9, 2), '.', substr(birth, 6, 2), '.', substr(birth, 1, 4)) WHEN k % 6 = 2 THEN dob WHEN k % 6 = 3 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) WHEN k % 6 = 4 THEN concat(substr(birth, 1, 5), '07', substr(birth, 8)) ELSE expiry END")
    return fx.identities(spark, sf).select("k", match.dates_match(F.col("birth"), other).alias("matches"))


def name_compatible(spark: SparkSession, sf: str) -> DataFrame:
    other = F.expr("CASE WHEN k % 4 = 0 THEN substr(surname, 1, 4) WHEN k % 4 = 1 THEN concat(surname, 'A') WHEN k % 4 = 2 THEN NULL ELSE concat('X', surname) END")
    return fx.identities(spark, sf).select("k", match.names_compatible(F.col("surname"), other).alias("compatible"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("id_front", "id_back", "passport", "general_document")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("dossier_id"), F.row_number().over(order).alias("page_number"), kind.alias("page_type"), "o_orderkey")


def dossier_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return cards.first_pages(_pages(spark, sf), "dossier_id", "page_number", "page_type", 10).select("dossier_id", "page_type", "page_number", "o_orderkey")


def dossier_merge(spark: SparkSession, sf: str) -> DataFrame:
    return cards.dossiers(_pages(spark, sf), max_pages=10)


def dossier_profiles(spark: SparkSession, sf: str) -> DataFrame:
    sides = fx.sides(spark, sf).select(F.col("key").alias("dossier_id"), (F.col("upload") + 1).alias("page_number"), F.col("detected_side").alias("page_type"), F.struct("*").alias("record"))
    df = cards.merged_dossiers(sides, "record", tasks=fx.session_tasks(spark, sf))
    return df.select("dossier_id", "dossier_type", F.col("merged.overall_status").alias("overall_status"), "front_page", "back_page")


def page_classify(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("string")
    df = fx.identities(spark, sf)
    k = F.col("k")
    r = F.struct(F.when(k % 7 == 0, F.lit(zone.TD1)).when(k % 7 == 1, F.lit(zone.TD3)).alias("mrz_format"), F.when(k % 7 == 2, F.lit("id_front")).alias("detected_side"), F.when(k % 7 == 3, F.col("pinfl")).alias("jshshir"), (k % 2 == 0).alias("face_detected"), null.alias("patronymic"), F.when(k % 7 == 4, F.col("doc")).alias("document_number"), F.when(k % 7 == 5, F.lit("identity card")).alias("raw_text"))
    return df.select("k", cards.page_type(r).alias("page_type"))


def token_sign_verify(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.spread(fx.table(spark, sf, "events").select("event_id")).select("event_id", F.concat(F.lit("s"), "event_id").alias("sid"), F.array(F.lit("BLINK"), F.lit("SMILE")).alias("chn"), (F.col("event_id") * 10).alias("exp"))
    df = df.withColumn("token", tokens.sign(F.col("sid"), F.col("chn"), F.col("exp"), QUERY_SECRET))
    tampered = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("A"), F.substring("token", 2, 10_000))).otherwise(F.col("token"))
    return df.select("event_id", "token", tokens.verify(tampered, F.lit(0), QUERY_SECRET)["reason"].alias("reason"))


def token_ttl(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.spread(fx.table(spark, sf, "events").select("event_id")).withColumn("exp", F.col("event_id") * 10)
    token = tokens.sign(F.lit("s"), F.array(F.lit("BLINK")), F.col("exp"), QUERY_SECRET)
    r = tokens.verify(token, F.col("event_id") % 97 * 300, QUERY_SECRET)
    return df.select("event_id", r.alias("r")).select("event_id", "r.valid", "r.reason", F.col("r.payload.exp").alias("exp"))


def challenge_draw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.spread(fx.table(spark, sf, "events").select("event_id")).select("event_id", F.array_join(tokens.choose(F.col("event_id"), 3), ",").alias("challenges"))


def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem")
    r = scores.quality(F.col("l_quantity") * 8, F.abs("l_discount") * 40, F.floor("l_extendedprice") % 256, (200 + F.col("l_partkey") % 900).cast("int"), (300 + F.col("l_suppkey") % 900).cast("int"))
    return df.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.score", "r.is_acceptable", "r.is_blurry", "r.has_glare", "r.brightness_level", F.array_join("r.recommendations", ",").alias("recommendations"))


def tamper_risk(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem")
    r = scores.tampering(F.floor("l_quantity") % 6, 1 + F.abs("l_tax") * 60, F.floor("l_extendedprice") % 30)
    return df.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.risk_score", "r.risk_level", "r.tampering_detected", F.array_join("r.flags", ",").alias("flags"))


def patch_outliers(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("image"), F.floor("l_quantity").cast("double").alias("mean"))
    return liveness.outlier_patches(df, ["image"])


def _blended(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    ids = a.agg((F.max("vec_id") + 1).alias("n")).first()["n"] or 1
    # the last vector's neighbour is the first
    b = fx.table(spark, sf, "embeddings").select(F.pmod(F.col("vec_id") - 1, F.lit(ids)).alias("vec_id"), F.col("embedding").alias("b"))
    w = F.col("vec_id") % 6 / 5
    mixed = F.zip_with("a", "b", lambda x, y: w * x.cast("double") + (1 - w) * y.cast("double"))
    return a.join(b, "vec_id").select("vec_id", scores.cosine(F.col("a"), mixed).alias("cosine"))


def face_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _blended(spark, sf).select("vec_id", F.round("cosine", 6).alias("cosine"))


def face_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", scores.face_percent(F.col("event_id") % 1001 / 1000.0).alias("percent"))


def face_verdict(spark: SparkSession, sf: str) -> DataFrame:
    df = _blended(spark, sf).withColumn("v", scores.face_verdict(scores.face_percent(F.round("cosine", 6)), 60.0))
    return df.groupBy(F.col("v.verdict").alias("verdict"), F.col("v.match").alias("match")).agg(F.count("*").alias("n"))


def kyc_match(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("lbp"), (F.col("l_quantity") / 50).alias("structure"), F.lit(0.2).alias("keypoints"), F.abs("l_discount").alias("eyes"), F.abs("l_tax").alias("mouth"), (F.col("l_linenumber") / 8).alias("selfie_coverage"), (F.col("l_orderkey") % 2 == 0).alias("selfie_cut_off"))
    return liveness.kyc(df).select("l_orderkey", "l_linenumber", "face.*")


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = fx.table(spark, sf, "events").select("user_id", "event_id", "value", (F.row_number().over(order) - 1).alias("rn"))
    return df.select("user_id", F.floor(F.col("rn") / 3).alias("part"), (F.col("rn") % 3).cast("int").alias("idx"), F.col("value").alias("area"), F.lit(0.0).alias("center"), F.lit(1.0).alias("width"), "event_id")


def movement_check(spark: SparkSession, sf: str) -> DataFrame:
    df = liveness.movements(_frames(spark, sf), ["user_id", "part"])
    return df.groupBy(liveness.movement(F.col("area_ratio")).alias("movement")).agg(F.count("*").alias("n"))


def liveness_session(spark: SparkSession, sf: str) -> DataFrame:
    df = liveness.movements(_frames(spark, sf), ["user_id", "part"])
    kind = F.when(F.col("idx") == 1, "MOVE_CLOSER").otherwise("MOVE_AWAY")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    step = scores.challenge(kind, yes, yes, F.col("area_ratio"), F.col("shift"), no, zero, zero)
    steps = df.select("user_id", "part", step["passed"].alias("passed"), step["confidence"].alias("confidence"), (F.col("user_id") % 4 * 20.0).alias("spoof_score"), (F.col("user_id") % 5 + 1).alias("frames"))
    return liveness.sessions(steps, ["user_id", "part"])


def spoof_score(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "lineitem")
    r = scores.spoof(F.col("l_quantity") / 8, F.col("l_linenumber") % 4, F.abs("l_discount") * 100, F.abs("l_tax") * 100)
    return df.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.score", "r.is_spoof", F.array_join("r.flags", ",").alias("flags"))


def stability_counter(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("present"), (F.col("value") >= 20).alias("stable"))
    return folds.final(df, "user_id", ["ts", "event_id"], ["present", "stable"], lambda: folds.Stability(3), "counter long, fired boolean")


def throttle_window(spark: SparkSession, sf: str) -> DataFrame:
    df = liveness.rate_windows(fx.table(spark, sf, "events"), "user_id", "ts", "1 day", 4)
    return df.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "requests", "throttled")


def media_sniff(spark: SparkSession, sf: str) -> DataFrame:
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425000", "5249464600000000", "424D36", "49492A00", "4D4D002A", "25504446", "00"]
    df = fx.table(spark, sf, "customer").select("c_custkey", F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("c_custkey") % 9 + 1).cast("int"))).alias("content"))
    side = (50 + F.col("c_custkey") % 300).cast("int")
    return df.select("c_custkey", media.image_kind(F.col("content")).alias("kind"), media.image_rejection(F.col("content"), F.col("c_custkey") * 20_000, side, side * 200).alias("rejection"))


def face_rank(spark: SparkSession, sf: str) -> DataFrame:
    box = F.struct((F.col("l_partkey") % 400).cast("int").alias("x"), (F.col("l_suppkey") % 300).cast("int").alias("y"), (F.col("l_quantity") + 20).cast("int").alias("w"), (F.col("l_quantity") * 1.2 + 20).cast("int").alias("h"))
    df = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", box.alias("b")))).alias("c"))
    best = liveness.best_face(F.transform("c", lambda x: x["b"]), F.lit(640))
    df = df.withColumn("b", best)
    return df.select("l_orderkey", "b.*", liveness.framed(F.col("b"), F.lit(640), F.lit(480))["is_cut_off"].alias("is_cut_off"))


def page_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return liveness.page_confidence(fx.table(spark, sf, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("c")), "l_orderkey", "c")


def response_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select("c_custkey", sinks.status_code(k % 2 == 0, F.when(k % 5 == 0, "invalid").when(k % 7 == 0, "error")).cast("long").alias("status_code"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in ("queries", "oracle_sql")]
    return {f.__name__: f for f in found} | flows.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | flow_oracles.sql()
