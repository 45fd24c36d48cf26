"""Ordered folds: batches of rows in any split and order give what one fold over all rows in order gives."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from docsieve.operators import admission, folds, liveness
from docsieve.streaming import ordered

from .test_streaming import finished

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    ordered.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, rows, end, schema, batches, name, **kw):
    """rows, dealt into batches of files that hold them in any order; a last batch moves the watermark past all others."""
    for i, part in enumerate([*(rows[i::batches] for i in range(batches)), [end]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "new"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / "new").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i:03d}.parquet")
        shutil.rmtree(tmp_path / "new")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ordered.in_order(stream, **kw).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    finished(out.trigger(availableNow=True).start())
    return spark.table(name).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_stability_in_event_time(spark, state_store, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(s, i, DAY + datetime.timedelta(milliseconds=40 * i + s), (s * 7 + i * i) % 9 != 0, (s + i) % 5 != 0) for s in range(4) for i in range(60)]
    order = {(s, i): draw.random() for s in range(4) for i in range(60)}
    shuffled = sorted(rows, key=lambda r: order[r[:2]])
    end = (99, 0, DAY + datetime.timedelta(hours=5), True, True)
    schema = "session_id long, idx int, ts timestamp, present boolean, stable boolean"
    got = streamed(spark, tmp_path, shuffled, end, schema, 5, f"ordered{seed}", key="session_id", at="ts", order="idx", values=["present", "stable"], make=lambda: folds.Stability(4), out="counter int, fired boolean", delay="1 hour")
    assert len(got) == 240 and len({r[:2] for r in got}) == 240
    frames = spark.createDataFrame(rows, schema).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("idx", "present", "stable"))).alias("f"))
    for i in (10, 59):
        head = F.slice("f", 1, i + 1)
        want = {r["session_id"]: tuple(r["r"]) for r in frames.select("session_id", liveness.stability(head, 4).alias("r")).collect()}
        assert {r["session_id"]: (r["counter"], r["fired"]) for r in got if r["idx"] == i} == want


def brute(rows, make):
    """One rule a key, over all of its requests in order."""
    out, rules = {}, {}
    for key, at, i in sorted(rows):
        out[i] = rules.setdefault(key, make()).admit(int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))
    return out


def requests(n, seed):
    draw = random.Random(seed)
    return [(draw.choice("aaabc"), DAY + datetime.timedelta(milliseconds=int(draw.expovariate(1 / 60_000) * 20) + 1000 * draw.randrange(600)), i) for i in range(n)]


RULES = {"leaky": lambda: admission.LeakyBucket(30, 60_000, 10), "log": lambda: admission.SlidingLog(30, 60_000)}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_admission_in_batch_is_one_fold_a_key(spark, rule):
    rows = requests(3000, 5)
    df = spark.createDataFrame(rows, "user string, ts timestamp, id int").withColumn("admitted_at", F.lit("own")).repartition(7)
    got = admission.admitted(df, "user", "ts", "id", RULES[rule])
    assert got.columns == ["user", "ts", "id", "admitted_at", "admitted"]
    want = brute(rows, RULES[rule])
    assert {r["id"]: r["admitted"] for r in got.collect()} == want and 0 < sum(want.values()) < 3000


def test_admission_of_odd_rows(spark):
    schema = "user string, ts timestamp, id int"
    rows = [("a", DAY, 1), ("a", DAY, 2), (None, DAY, 3), ("a", None, 4), ("a", DAY, 2)]
    got = admission.admitted(spark.createDataFrame(rows, schema), "user", "ts", "id", lambda: admission.SlidingLog(2, 1000)).collect()
    assert sorted((r["id"], r["admitted"]) for r in got if r["id"] != 2) == [(1, True), (3, None), (4, None)]
    assert sorted(r["admitted"] for r in got if r["id"] == 2) == [False, True]
    assert admission.admitted(spark.createDataFrame([], schema), "user", "ts", "id", RULES["log"]).count() == 0


def test_burst_and_refill():
    rule = admission.LeakyBucket(30, 60_000, 10)
    assert [rule.admit(0) for _ in range(13)] == [True] * 11 + [False] * 2
    assert [rule.admit(2000), rule.admit(2000), rule.admit(3999), rule.admit(4000)] == [True, False, False, True]


@pytest.mark.parametrize("rule", sorted(RULES))
def test_admission_as_a_stream(spark, state_store, tmp_path, rule):
    rows = requests(400, 9)
    end = ("z", DAY + datetime.timedelta(days=3), 9999)
    random.Random(3).shuffle(rows)
    got = streamed(spark, tmp_path, rows, end, "user string, ts timestamp, id int", 4, f"admission_{rule}", key="user", at="ts", order="id", values=[], make=lambda: ordered.Admission(RULES[rule]()), out="admitted boolean", delay="1 day")
    assert {r["id"]: r["admitted"] for r in got} == brute(rows, RULES[rule])


def test_final_states_in_batch(spark):
    rows = [(None if s == 3 else s, i, (s * 7 + i * i) % 9 != 0, (s + i) % 5 != 0) for s in range(4) for i in range(900)]
    df = spark.createDataFrame(rows, "session_id long, idx int, present boolean, stable boolean").repartition(5)
    got = {r["session_id"]: (r["counter"], r["fired"]) for r in folds.final(df, "session_id", ["idx"], ["present", "stable"], lambda: folds.Stability(7), "counter int, fired boolean").collect()}
    frames = df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("idx", "present", "stable"))).alias("f"))
    assert got == {r["session_id"]: tuple(r["r"]) for r in frames.select("session_id", liveness.stability(F.col("f"), 7).alias("r")).collect()} and len(got) == 4
    assert folds.final(df.where("false"), "session_id", ["idx"], ["present", "stable"], lambda: folds.Stability(7), "counter int, fired boolean").count() == 0
