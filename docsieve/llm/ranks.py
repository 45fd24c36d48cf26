"""Global order without a single task: range partitions, then a rank from partition offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Settled


def _laid_out(df: DataFrame, order: str) -> DataFrame:
    """df sorted into range partitions, written so that the partition numbers stay: part, place (from 1) and the columns of df.

    The cut points are sampled and differ between runs; ranks do not depend on them.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = Settled(df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "range")
    return cut.df


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with rank (from 0) in the order of a unique column."""
    cut = _laid_out(df, order)
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, not for each row of df
    offset = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return cut.withColumn("place", place).join(F.broadcast(offset), "part").withColumn("rank", F.col("offset") + F.col("place") - 1).drop("part", "place", "offset", order)


def running(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with before_<column>: the sum of each column over the rows before, in the order of a unique column."""
    cut = _laid_out(df, order)
    sums = cut.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, not for each row of df
    offset = sums.select("part", *[F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"offset_{c}") for c in columns])
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumns({f"inside_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(F.broadcast(offset), "part")
    return summed.select(*df.columns, *[(F.col(f"offset_{c}") + F.col(f"inside_{c}")).alias(f"before_{c}") for c in columns])
