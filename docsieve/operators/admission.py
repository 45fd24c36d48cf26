"""Admission of requests by rate: which of a key's requests pass a leaky bucket or a sliding log. Refused requests don't count.

Both are ordered folds with a small state, so a key's requests must be taken in turn, but not all of them in one task: after a pause that empties the
bucket or the log nothing is remembered. Requests are put into periods of that length, runs of periods without a pause are folded on their own, and a
sort inside partitions streams them through, with a batch of rows and one state in memory however long a run is.

Times are milliseconds and levels whole numbers (a request is as many as the rate's milliseconds), so results are exact. Requests of equal time are taken in the order of ``order``.
Requests without a key or time are in no turn: admitted is null.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

class LeakyBucket:
    """Drains by ``requests`` in ``millis``, holds ``burst`` beside the request that finds it empty."""

    def __init__(self, requests: int, millis: int, burst: int):
        self.drain, self.cost, self.most = requests, millis, burst * millis
        #: Milliseconds after which any level has drained.
        self.memory = -(-(burst + 1) * millis // requests)
        self.reset()

    def reset(self) -> None:
        self.level, self.last = None, 0

    def admit(self, at: int) -> bool:
        level = 0 if self.level is None else max(0, self.level - self.drain * (at - self.last) + self.cost)
        if level > self.most:
            return False
        self.level, self.last = level, at
        return True

    def state(self) -> list:
        return [self.level, self.last]

    def restore(self, state: list) -> None:
        self.level, self.last = state


class SlidingLog:
    """At most ``limit`` admitted requests in any ``millis``."""

    def __init__(self, limit: int, millis: int):
        self.limit, self.memory = limit, millis
        self.reset()

    def reset(self) -> None:
        self.log: deque[int] = deque()

    def admit(self, at: int) -> bool:
        while self.log and self.log[0] <= at - self.memory:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(at)
        return True

    def state(self) -> list:
        return list(self.log)

    def restore(self, state: list) -> None:
        self.log = deque(state)


def runs(events: DataFrame, key: str, at: str, millis: int) -> DataFrame:
    """events with ``run``: the first of the key's periods that follow each other without a pause. Only distinct periods of a key are sorted."""
    period = F.floor(F.unix_millis(F.col(at).cast("timestamp")) / millis)
    placed = events.withColumn("period", period)
    seen = placed.where(F.col(key).isNotNull() & F.col("period").isNotNull()).select(key, "period").distinct()
    w = Window.partitionBy(key).orderBy("period")
    starts = seen.withColumn("start", F.when(F.coalesce(F.lag("period").over(w) != F.col("period") - 1, F.lit(True)), F.col("period")))
    known = starts.select(key, "period", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return placed.join(known, [key, "period"], "left").select(*[placed[c] for c in events.columns], "run")


def _folded(batches: Iterator[pa.RecordBatch], make: Callable[[], LeakyBucket | SlidingLog]) -> Iterator[pa.RecordBatch]:
    rule, now = make(), None
    for batch in batches:
        keys, run, at = (batch.column(i).to_pylist() for i in range(3))
        out: list[bool | None] = []
        for k, r, t in zip(keys, run, at):
            if r is None:
                out.append(None)
                continue
            if (k, r) != now:
                now = k, r
                rule.reset()
            out.append(rule.admit(t))
        rest = batch.columns[3:]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.bool_())], [*batch.schema.names[3:], "admitted"])


def admitted(events: DataFrame, key: str, at: str, order: str, make: Callable[[], LeakyBucket | SlidingLog]) -> DataFrame:
    """events with ``admitted``; ``make`` gives a rule, such as ``lambda: LeakyBucket(30, 60_000, 10)``."""
    memory = make().memory
    wide = runs(events, key, at, memory).select(F.col(key).alias("_key"), F.col("run").alias("_run"), F.unix_millis(F.col(at).cast("timestamp")).alias("_at"), *events.columns)
    in_turn = wide.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_at", order)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields], "admitted boolean"])
    return in_turn.mapInArrow(lambda batches: _folded(batches, make), schema)
