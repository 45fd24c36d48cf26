"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from docsieve.operators import liveness
from docsieve.sources import sinks
from docsieve.streaming import frames


def finished(query, seconds=120):
    """Waits for a stream that ends by itself, and not for ever."""
    ended = query.awaitTermination(seconds)
    query.stop()
    assert ended


def test_stability_stream_is_the_batch_fold(spark, tmp_path):
    rows = [(s, i, (s * 7 + i) % 5 != 0, (s + i) % 4 != 0) for s in range(3) for i in range(40)]
    schema = "session_id long, idx int, present boolean, stable boolean"
    src = str(tmp_path / "in")
    spark.createDataFrame([r for r in rows if r[1] < 20], schema).coalesce(1).write.json(src)
    spark.createDataFrame([r for r in rows if r[1] >= 20], schema).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).json(src)
    # a processing-time timeout asks for another batch for ever, so batches without data are off while the test waits for the end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        finished(frames.stability(stream, fire_at=4).writeStream.format("memory").queryName("stability").outputMode("update").trigger(availableNow=True).start())
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r["session_id"], r["frames"]): (r["counter"], r["fired"]) for r in spark.table("stability").collect()}
    df = spark.createDataFrame(rows, schema).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("idx", "present", "stable"))).alias("f"))
    for r in df.select("session_id", liveness.stability(F.col("f"), 4).alias("r")).collect():
        assert got[r["session_id"], 40] == (r["r"]["counter"], r["r"]["fired"])


def test_throttle_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT id % 2 AS user, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id AS INT),0) AS ts FROM range(10)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user long, ts timestamp").parquet(src)
    finished(frames.throttled(stream, "user", "ts", "1 hour", 4).writeStream.format("memory").queryName("throttle").outputMode("complete").trigger(availableNow=True).start())
    assert sorted((r["user"], r["requests"], r["throttled"]) for r in spark.table("throttle").collect()) == [(0, 5, True), (1, 5, True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', True)], "k long, v string, ok boolean")
    r = sinks.responses(df, "ok").first()
    assert r["status_code"] == 200 and '"k":1' in r["body"]
    sinks.write_csv(df.select("k", "v"), str(tmp_path / "csv"))
    lines = {x for p in (tmp_path / "csv").glob("part-*") for x in p.read_text().splitlines()}
    assert lines == {'"k","v"', '"1","say ""hi"""'}
    assert df.select(sinks.data_uri(F.encode("v", "utf-8"))).first()[0].startswith("data:image/jpeg;base64,")
