"""Work on many narrow rows: dealt out to tasks by the number of rows, and each value worked out once."""

import numpy as np
from pyspark.sql import functions as F

from docsieve.functions import tokens
from docsieve.operators import extract, linkage
from docsieve.operators.extract_words import name_like
from docsieve.plans import fixtures as fx
from docsieve.plans import flows, registry


def folder(spark, tmp_path, rows):
    """Tables of one small file each, as a narrow table of many rows has few."""
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("events", "event_id")):
        spark.range(rows).withColumnRenamed("id", key).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_tasks_grow_with_rows():
    assert [fx.tasks_for(n, 12) for n in (0, 1, 1500, 18_000, 900_000, 5_400_000)] == [1, 1, 3, 36, 90, 540]


def test_one_small_file_is_many_tasks(spark, tmp_path):
    d = folder(spark, tmp_path, 6000)
    cores = spark.sparkContext.defaultParallelism
    made = {"identities": fx.identities(spark, d), "rasters": flows.rasters(spark, d, "part", "p_partkey"), "token_ttl": registry.token_ttl(spark, d)}
    for name, df in made.items():
        assert df.rdd.getNumPartitions() == min(12, 3 * cores), name
        assert df.count() == 6000, name


def test_a_label_with_an_apostrophe_is_no_name(spark):
    texts = spark.createDataFrame([("Familiyasi\nAMALKOV\nIsmi\nDILSHOD\nKARIMOVICH\nTug'ilgan sanasi\n01.02.1990",)], "text string")
    assert extract.names(texts).select("names.*").first() == ("DILSHOD", None, "KARIMOVICH")
    assert not spark.range(1).select(name_like(F.lit("TUG'ILGAN"), 3)).first()[0]


def test_a_token_is_signed_and_checked_once(spark, tmp_path):
    plan = registry.token_ttl(spark, folder(spark, tmp_path, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 4, plan.count("sha2(")


def test_tokens_verdicts(spark):
    df = spark.createDataFrame([(1,)], "i int").withColumn("t", tokens.sign(F.lit("s"), F.array(F.lit("BLINK")), F.lit(10), "x"))
    cases = {"ok": F.col("t"), "forged": F.concat("t", F.lit("0")), "malformed": F.lit("no token"), "none": F.lit(None).cast("string")}
    got = df.select(*[tokens.verify(t, F.lit(10), "x").alias(n) for n, t in cases.items()], tokens.verify(F.col("t"), F.lit(11), "x").alias("late")).first()
    assert [got[n]["reason"] for n in (*cases, "late")] == ["ok", "forged", "malformed", "malformed", "expired"]
    assert got["ok"]["valid"] and got["ok"]["payload"]["exp"] == 10 and got["late"]["payload"] is None


def test_pixels_same_as_their_sql(spark):
    """Rasters of many keys at once, against the expressions that the SQL has."""
    keys = [0, 1, 2, 3, 7, 11, 14, 19_999, 7_200_001]
    made = flows._pixels(np.array(keys))
    at = spark.createDataFrame([(i, k, x, y) for i, k in enumerate(keys) for x in range(flows.SIDE) for y in range(flows.SIDE)], "i int, k long, x long, y long")
    for r in at.selectExpr("i", "x", "y", *[f"{flows.PIXEL[c]} AS {c}" for c in "bgr"]).collect():
        assert tuple(made[r["i"], r["y"], r["x"]].tolist()) == (r["b"], r["g"], r["r"])


def most_sessions(df):
    """Sessions that the fullest task has."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_a_task_meets_no_more_sessions_in_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", (50, 100))
    monkeypatch.setattr(fx, "TASKS_A_CORE", 1)
    d = folder(spark, tmp_path, 4000)
    for name in ("dossier_profiles", "auto_swap", "two_sided_merge", "_merged"):  # the last is what merge_status_counts counts
        assert most_sessions(getattr(registry, name)(spark, d)) <= 200, name


def test_dealt_dossiers_are_the_same(spark):
    row = ", ".join(f"concat('{n}', key, page) AS {n}" for n in linkage.FIELDS)
    at = "explode(sequence(0, 39)) AS i"
    pages = spark.range(1).selectExpr(at).selectExpr("CASE WHEN i < 3 THEN NULL ELSE i % 11 END AS key", "i DIV 11 * 5 + 1 AS page", "element_at(array('id_front', 'id_back', 'passport'), CAST(i % 3 + 1 AS INT)) AS kind")
    pages = pages.selectExpr("key", "page", "kind", f"struct({row}, kind AS detected_side, CAST(NULL AS STRING) AS mrz_format, kind = 'id_front' AS face_detected, 90.0D AS confidence) AS record")
    got = [sorted(map(repr, linkage.merged_dossiers(pages, "record", "key", "page", "kind", tasks=n).collect())) for n in (None, 1, 7)]
    assert len(got[0]) == 12 and got[0] == got[1] == got[2]


def test_dealt_sessions_are_the_same(spark):
    at = "explode(sequence(0, 39)) AS i"
    sides = spark.range(1).selectExpr(at).selectExpr("CASE WHEN i < 3 THEN NULL ELSE i % 13 END AS key", "i DIV 13 AS upload", "concat('s', i % 13, i DIV 13) AS value").where("NOT (upload = 1 AND key = 5) AND NOT (key IS NULL AND upload = 0 AND value <> 's00')")
    got = [sorted(map(repr, linkage.pair_up(sides, ["key"], tasks=n).collect())) for n in (None, 1, 7)]
    assert len(got[0]) == 14 and got[0] == got[1] == got[2]
