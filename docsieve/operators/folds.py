"""Ordered folds with a small state a key, over rows that a sort streams through: memory holds a batch and one state, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Frames that must be stable before the shutter fires.
FIRE_AT = 18


class Fold(Protocol):
    """State is a list that JSON can hold; ``step`` takes the time in milliseconds and the row's values and gives the values to emit."""

    def state(self) -> list: ...

    def restore(self, state: list) -> None: ...

    def step(self, at: int, values: list) -> list: ...


class Stability:
    """The counter of a camera session: up while the document is there and still, down while it moves, back to 0 without it; fired once it was ``fire_at``."""

    def __init__(self, fire_at: int = FIRE_AT):
        self.fire_at, self.counter, self.fired = fire_at, 0, False

    def state(self) -> list:
        return [self.counter, self.fired]

    def restore(self, state: list) -> None:
        self.counter, self.fired = state

    def step(self, at: int, values: list) -> list:
        present, stable = values
        self.counter = self.counter + 1 if present and stable else max(0, self.counter - 1) if present else 0
        self.fired = self.fired or self.counter >= self.fire_at
        return [self.counter, self.fired]


def final(rows: DataFrame, key: str, order: list[str], values: list[str], make: Callable[[], Fold], out: str) -> DataFrame:
    """(key, what the fold last emitted, as ``out`` says) of each key, its rows taken in the order of ``order``. Null is a key of its own."""
    schema = StructType.fromDDL(f"`{key}` {rows.schema[key].dataType.simpleString()}, {out}")
    types, names = [to_arrow_type(f.dataType) for f in schema], schema.names
    n = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, last = None, None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[0] != now:
                    if fold is not None:
                        done.append((now, *last))
                    now, fold = row[0], make()
                last = fold.step(0, list(row[1 : 1 + n]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
        if fold is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, *last), types)], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, *values).mapInArrow(run, schema)
