"""Ordered folds over a stream in event time: rows wait in state until the watermark has passed them, then are folded in the order of their time.

However rows are split into batches and shuffled between them, within the watermark's delay, each row is folded once and at its place; rows later than that are
dropped by the watermark. State a key: the fold's own, and the rows that wait, which the delay bounds. Needs the RocksDB state store (``state_store``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import LeakyBucket, SlidingLog
from ..operators.folds import Fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission:
    """A rule of ``operators.admission`` as a fold."""

    def __init__(self, rule: LeakyBucket | SlidingLog):
        self.rule, self.state, self.restore = rule, rule.state, rule.restore

    def step(self, at: int, values: list) -> list:
        return [self.rule.admit(at)]


class _InOrder(StatefulProcessor):
    def __init__(self, make: Callable[[], Fold], names: list[str]):
        self.make, self.names = make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "state string")
        self.waiting = handle.getListState("waiting", "at long, place string, vals string")

    def _ready(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rows = [(at, json.loads(place), json.loads(values)) for at, place, values in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= watermark), key=lambda r: r[:2])
        if not due:
            return
        later = [r for r in rows if r[0] > watermark]
        if later:
            self.waiting.put([(at, json.dumps(place), json.dumps(values)) for at, place, values in later])
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        fold = self.make()
        if self.fold.exists():
            fold.restore(json.loads(self.fold.get()[0]))
        out = [(key[0], *place, *fold.step(at, list(values.values()))) for at, place, values in due]
        self.fold.update((json.dumps(fold.state()),))
        yield pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at), place, values) for part in rows for at, place, values in part[["millis_", "place_", "values_"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return self._ready(key, timerValues.getCurrentWatermarkInMs())


def state_store(spark: SparkSession) -> None:
    """The state store that timers and lists of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(rows: DataFrame, key: str, at: str, order: str, values: list[str], make: Callable[[], Fold], out: str, delay: str = "10 minutes") -> DataFrame:
    """(key, order, what the fold emits as ``out`` says) of every row of a stream, folded a key in the order of (at, order)."""
    kinds = dict(rows.dtypes)
    told = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if values else F.lit("{}")
    waiting = rows.withWatermark(at, delay).select(key, at, F.unix_millis(F.col(at)).alias("millis_"), F.to_json(F.array(order)).alias("place_"), told.alias("values_"))
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {out}"
    names = [key, order, *[f.split()[0] for f in out.split(", ")]]
    return waiting.groupBy(key).transformWithStateInPandas(_InOrder(make, names), schema, "Append", "EventTime")
