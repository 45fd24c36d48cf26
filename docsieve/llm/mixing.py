"""Mixing sources to target weights: pivotal dependent rounding, in DataFrame functions alone.

A document's wanted number of copies is its source's target over the source's size, up to 3. The whole part is certain; the
fraction is rounded by the pivotal method: two fractional units meet, mass moves from one to the other at random until one of them is
whole, the other goes on. A fold over a block of documents of one source and of like size does this and leaves at most one fractional
unit; the units left by blocks meet in blocks of the next level, a reduction tree whose levels each shrink the table by about ``BLOCK``. Sums of
fractions are kept at every step, and like sizes meet, so each source's taken words come near its target.

The dice are hashes of ids, so reruns agree; blocks are made of hashed ids and bounded size classes, so no group is unbounded.
Defined cases: null and wordless texts have size 0 and are taken 0 times; sources rank by code point, null last, and weigh 1, 2, 3,
repeating; rows that repeat (doc_id, source, size) share one decision; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked, running
from .store import Settled, small, tidy

BLOCK = 256
MOST = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): shares of the whole by weight; a source stops at MOST times its size and the rest is reshared."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    table = Settled(ranked(by_source.withColumn("order", order), "order"), "sources").df
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    # The common level of target per weight rises until no further source is above its cap. Sources reach their caps in the order of cap by weight:
    # one is full if the level that is left once all before it are full lies above its cap.
    size, weights = (float(x or 0) for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    in_turn = running(table.withColumn("turn", F.struct((F.col("cap") / F.col("weight")).alias("level"), "rank")), "turn", ["cap", "weight"])
    full = (F.lit(size) - F.col("before_cap")) * F.col("weight") > F.col("cap") * (F.lit(weights) - F.col("before_weight"))
    capped, rest = (float(x or 0) for x in in_turn.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first())
    level = (size - capped) / rest if rest else 0.0
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap")).alias("target"))


def _dice(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def _meet(block: Column) -> Column:
    """Fold a block of struct<order, id, size, f, dice> into struct<held id, size, f, done array<struct<id, take>>>."""
    none = F.expr("array(named_struct('id', 0L, 'take', 0L))")
    start = F.struct(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("f"), F.slice(none, 1, 0).alias("done"))

    def held(unit, f, done):
        return F.struct(unit["id"].alias("id"), unit["size"].alias("size"), f.alias("f"), done.alias("done"))

    def step(s, x):
        total = s["f"] + x["f"]
        decided = lambda unit, take: F.array_append(s["done"], F.struct(unit["id"].alias("id"), F.lit(take).cast("long").alias("take")))
        # below 1 one unit takes all the mass, each with its share as chance; from 1 on one becomes whole and the other keeps the rest
        low = F.when(x["dice"] * total < s["f"], held(s, total, decided(x, 0))).otherwise(held(x, total, decided(s, 0)))
        high = F.when(x["dice"] * (2 - total) < 1 - x["f"], held(x, total - 1, decided(s, 1))).otherwise(held(s, total - 1, decided(x, 1)))
        return F.when(s["id"].isNull(), held(x, x["f"], s["done"])).when(total < 1, low).otherwise(high)

    return F.aggregate(block, start, step)


def pivotal(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_key, id, take): 0 or 1 for each unit (source_key, id, size, f), 0 < f < 1, ids unique.

    Each level deals the units of a source and size class into blocks by hashed id. When no class has more than a block of units, the
    classes of a source meet, largest sizes first: what is left for the last dice is small.
    """
    decided: list[DataFrame] = []
    now, level, whole_source = units.select("source_key", "id", "size", "f", F.floor(F.log2(F.col("size") + 1.0) * 8).alias("class")), 0, False
    while True:
        counts = Settled(now.groupBy("source_key", "class").agg(F.count("*").alias("n")), "counts").df
        most = counts.agg(F.max("n")).first()[0] or 0
        keyed = now.join(counts, ["source_key", "class"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.ceil(F.col("n") / block)))
        one = F.struct((-F.col("size")).alias("order"), "id", "size", "f", _dice(F.col("id"), F.lit(level), F.lit("dice")).alias("dice"))
        folded = keyed.groupBy("source_key", "class", "block").agg(_meet(F.sort_array(F.collect_list(one))).alias("s"))
        done = Settled(folded, "folded").df
        decided.append(done.select("source_key", F.explode("s.done").alias("d")).select("source_key", "d.id", "d.take"))
        held = done.select("source_key", "s.id", "s.size", "s.f", "class")
        whole = (F.col("f") < 1e-9) | (F.col("f") > 1 - 1e-9)
        decided.append(held.where(whole).select("source_key", "id", F.round("f").cast("long").alias("take")))
        held = held.where(~whole)
        if whole_source and most <= block:
            # one unit is left in each source
            decided.append(held.select("source_key", "id", (_dice(F.col("id"), F.lit("last")) < F.col("f")).cast("long").alias("take")))
            break
        whole_source = whole_source or most <= block
        now = held.withColumn("class", F.lit(0).cast("long")) if whole_source else held
        level += 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


@tidy
def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs."""
    sizes = Settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes").df
    goal = small(Settled(targets(sizes), "targets").df)
    goal = goal.withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a copy within rounding of a whole number is whole
    whole = F.floor(ratio + 1e-9)
    goal = goal.withColumn("whole", whole).withColumn("f", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    goal = goal.withColumn("f", F.when(F.col("f") < 1e-9, 0.0).otherwise(F.col("f")))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(sizes["doc_id"], sizes["source"], "size", "source_size", "target", "source_key", "whole", "f")
    rows = rows.withColumn("id", F.xxhash64("source_key", "size", F.col("doc_id").isNull(), "doc_id"))
    units = rows.where("f > 0 and size > 0").groupBy("source_key", "id", "f").agg(F.sum("size").alias("size"))
    taken = Settled(pivotal(units), "taken").df
    out = rows.join(taken, ["source_key", "id"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("take", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns as they were."""
    names = docs.columns
    found = Settled(mix(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")), "mix").df
    here = docs.select(F.struct(*names).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")).alias("d")
    f = small(found).alias("f")
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.size") == F.col("f.size"))
    copied = here.join(f, on).select("d.row", F.explode(F.sequence(F.lit(1), F.col("f.copies").cast("int"))).alias("copy"))
    return copied.select("row.*")
