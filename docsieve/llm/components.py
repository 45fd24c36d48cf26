"""Connected components of an edge table, by labels that spread to neighbours and jump along themselves.

In each round a node takes the smallest label among its neighbours' and its own, and then the label of that label, so labels travel about twice as
far in every round and a chain of n nodes needs about log n. A round is one written table; minima are combined before the shuffle,
and adaptive execution splits the joins of a hot node. Nothing is collected but whether a label changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node that it reaches; edges of a node to itself are left out."""
    one = edges.where("a != b").select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = Settled(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    label = Settled(both.df.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"), F.lit(True).alias("changed")), "label")
    while not label.df.where("changed").isEmpty():
        old = label.df.select("node", F.col("label").alias("before"))
        seen = both.df.join(old.select(F.col("node").alias("other"), F.col("before").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        near = old.join(seen, "node").select("node", "before", F.least("before", "seen").alias("near"))
        jump = near.join(old.select(F.col("node").alias("near"), F.col("before").alias("far")), "near")
        spread = Settled(jump.select("node", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("before")).alias("changed")), "label")
        label.drop()
        label = spread
    both.drop()
    return label.df.select("node", F.col("label").alias("component"))
