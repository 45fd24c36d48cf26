"""Stability of camera frames as a stream: a counter a session, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import FIRE_AT


def stability(frames: DataFrame, session: str = "session_id", idx: str = "idx", fire_at: int = FIRE_AT, idle_ms: int = 60_000) -> DataFrame:
    """(session_id, frames, counter, fired) after each batch, from frames with ``present`` and ``stable``; a session idle for ``idle_ms`` is forgotten.

    Within a batch frames are taken in the order of ``idx``; batches are taken as they come.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter, fired, seen = state.get if state.exists else (0, False, 0)
        rows = pd.concat(list(parts)).sort_values(idx)
        for present, stable in zip(rows["present"], rows["stable"]):
            counter = counter + 1 if present and stable else max(0, counter - 1) if present else 0
            fired = fired or counter >= fire_at
        seen += len(rows)
        state.update((counter, fired, seen))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({session: [key[0]], "frames": [seen], "counter": [counter], "fired": [fired]})

    kind = dict(frames.dtypes)[session]
    return frames.groupBy(session).applyInPandasWithState(run, f"{session} {kind}, frames long, counter int, fired boolean", "counter int, fired boolean, seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def throttled(events: DataFrame, key: str, at: str, width: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests of each key in tumbling windows of a stream; events later than ``late`` are dropped."""
    counted = events.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("throttled"))
