"""Centroid clustering of vectors in exact integers: blocked float64 matrix products behind magnitude bounds.

A component x becomes floor(64 * x). Squared distances are |x|^2 - 2 x.c + |c|^2, the products of a block of vectors by one matrix product. All terms are
integers, and where ``64 * (most of |x| + most of |c|)^2`` (for 64 components) stays below 2^53 every partial sum is exact in float64, in whatever order the
library adds. Vectors and centroids beyond that bound are set against each other in whole numbers of any size. Both agree, so a result depends neither on blocks
nor on machines.

Each round reads the kept vectors once, from a written table; a task gives one row of counts and sums a cluster, a tree of tasks adds them up
(``treeAggregate``), and the driver holds the centroids alone: clusters x components numbers. A lost executor costs its tasks.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; a repeated vec_id counts for each of its rows,
and among equal hashes the smaller components come first as a centroid; a null vec_id hashes as the empty text; with fewer vectors than clusters each starts
one; an empty table gives no rows. ``distance`` and the sums are exact; one above the range of a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Settled

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Vectors of one matrix product.
BLOCK = 4096
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, x array<double>): the vectors of exactly ``size`` finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vectors.where((F.size("embedding") == size) & finite).select("vec_id", x.alias("x"))


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) for any finite x."""
    return math.floor(scale * x) if abs(x) < EXACT else scale * int(x)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in that order; a top-k that each task cuts down to ``clusters`` rows."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[whole(v) for v in r["x"]] for r in vectors.withColumn("order", order).orderBy("order", "x").limit(clusters).collect()]


def distances(x: np.ndarray, rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, squared distance) of the vectors x, given as floor(SCALE * component) in float64 and, for the fallback, as they came (``rows``)."""
    size = x.shape[1]
    limit = math.isqrt(EXACT // size) // 2  # (limit + limit)^2 * size stays below EXACT
    most = [max(map(abs, c)) for c in centroids]
    low = [i for i, m in enumerate(most) if m < limit]
    nearest, best = np.zeros(len(x), np.int64), np.empty(len(x), dtype=object)
    done = (np.abs(x).max(axis=1) < limit) & bool(low)
    if done.any():
        a, c = x[done], np.array([centroids[i] for i in low], np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
        at = d.argmin(axis=1)
        nearest[done] = np.array(low)[at]
        best[done] = d[np.arange(len(d)), at].astype(np.int64).tolist()
    # a vector within the bound is nearer to every centroid within it than to one farther out than this
    rivals = [i for i, m in enumerate(most) if m >= limit and (m - limit) ** 2 <= EXACT]
    for i in np.arange(len(x)) if rivals else np.flatnonzero(~done):
        own = [whole(v) for v in rows[i]]
        found = min((sum((p - q) ** 2 for p, q in zip(own, centroids[j])), j) for j in (rivals if done[i] else range(len(centroids))))
        if not done[i] or found < (best[i], nearest[i]):
            best[i], nearest[i] = found
    return nearest, best


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for low in range(0, batch.num_rows, BLOCK):
        part = batch.slice(low, BLOCK)
        rows = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        with np.errstate(over="ignore"):
            yield part, rows, np.floor(rows * SCALE)


def partial_sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """One row a cluster with members in the task: cluster, n, and the sums of components as decimal text, which no size overflows."""
    n = [0] * len(centroids)
    sums = [[0] * len(c) for c in centroids]
    for batch in batches:
        for _, rows, x in _blocks(batch):
            nearest, _ = distances(x, rows, centroids)
            exact = np.abs(x).max(axis=1) < EXACT // BLOCK
            for k in np.unique(nearest).tolist():
                mine = nearest == k
                n[k] += int(mine.sum())
                total = x[mine & exact].sum(axis=0).astype(np.int64).tolist()
                for row in rows[mine & ~exact]:
                    total = [t + whole(v) for t, v in zip(total, row)]
                sums[k] = [a + b for a, b in zip(sums[k], total)]
    used = [k for k in range(len(n)) if n[k]]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[k] for k in used], pa.int64()), pa.array([[str(s) for s in sums[k]] for k in used], pa.list_(pa.string()))], ["cluster", "n", "sums"])


def _joined(a: dict[int, tuple[int, list[int]]], b: dict[int, tuple[int, list[int]]]) -> dict[int, tuple[int, list[int]]]:
    for k, (n, sums) in b.items():
        m, old = a.get(k, (0, [0] * len(sums)))
        a[k] = (m + n, [x + y for x, y in zip(old, sums)])
    return a


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round over the vectors (vec_id, x); empty clusters keep theirs."""
    parts = vectors.select("x").mapInArrow(lambda batches: partial_sums(batches, centroids), "cluster int, n long, sums array<string>")
    total = parts.rdd.treeAggregate({}, lambda a, r: _joined(a, {r["cluster"]: (r["n"], [int(s) for s in r["sums"]])}), _joined)
    return [[s // total[k][0] for s in total[k][1]] if k in total else c for k, c in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of the vectors (vec_id, x)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, x in _blocks(batch):
                nearest, best = distances(x, rows, centroids)
                long = pa.array([min(d, LONGEST) for d in best.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(nearest, pa.int32()), long], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(made, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = Settled(kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), size), "vectors")
    centroids = first_centroids(rows.df, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows.df, centroids)
    near = Settled(assigned(rows.df, centroids), "assigned")
    rows.drop()
    exact = F.col("distance").cast("decimal(38,0)")
    total = {r["cluster"]: int(r["total"]) for r in near.df.groupBy("cluster").agg(F.sum(exact).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(k, min(t, LONGEST), min(sum(total.values()), LONGEST), names[k]) for k, t in sorted(total.items())]
    # one row a cluster
    table = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return near.df.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
