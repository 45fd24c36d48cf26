"""Tables shared between the driver and the executors, and session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 500
#: Most rows (of ids and numbers) that are broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests), a new local folder kept in the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docsieve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_open: list[list[Settled]] = []


@contextmanager
def temporaries() -> Iterator[list[Settled]]:
    """Tables written inside are dropped at the end, but for those that are taken out of the list."""
    mine: list[Settled] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.pop()
        for table in mine:
            table.drop()


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written and all other tables that it wrote dropped."""

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        with temporaries() as mine:
            found = Settled(operator(*args, **named), operator.__name__)
            mine.remove(found)
        if _open:
            _open[-1].append(found)
        return found.df

    return run


class Settled:
    """A DataFrame written to the shared folder and read back: its lineage ends at files that survive lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _open:
            _open[-1].append(self)

    def drop(self) -> None:
        """Delete the files once a later table replaces them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, marked for broadcast if it has at most ``most`` rows; beyond that it is shuffled like any other."""
    return F.broadcast(df) if df.count() <= most else df


def settle(df: DataFrame, name: str) -> DataFrame:
    return Settled(df, name).df
