"""Sharding by jump consistent hashing, in DataFrame functions alone.

A key's jumps are drawn by the published 64-bit linear congruence; its shard is the last jump below the number of shards. The jumps do not depend on that
number, so appended shards take rows from the others and nothing else moves; no ring table is kept. Products of 64 bits are made of 32-bit halves, since
Spark's arithmetic raises on overflow.

Slots number the rows of a shard in the order of (doc_id, size, text_crc32). A shard is not one group: rows are dealt into ranges of that order, small
beside a shard, and a slot is the place in the range plus what lies before it. The order ends in a row number, so a doc_id that stands in a third of
the rows is cut as well. Texts are not shuffled, only their ids, sizes and checksums are.

Defined cases: the law is ``key``, so equal texts stay together only where their ids do; a null text has no bytes (size 1, checksum 0); a null doc_id is
the key 0 and the first in its shard; rows that repeat a doc_id share a shard and have slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .store import Settled, tidy

SHARDS = 16
#: The published multiplier, as two halves of 32 bits.
MULTIPLIER = divmod(2862933555777941757, 1 << 32)
LOW = (1 << 32) - 1
#: Jumps drawn before a key is asked whether it is done; about ln(shards) + 1 are needed.
DRAWS = 40


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of state * MULTIPLIER + 1 modulo 2^64."""
    top, low = (F.lit(m) for m in MULTIPLIER)
    half = F.lit(0xFFFF)
    bits = lambda x, n: F.shiftright(x, n)
    first = lo.bitwiseAND(half) * low + 1
    second = bits(lo, 16) * low + bits(first, 16)
    new_lo = F.shiftleft(second.bitwiseAND(half), 16).bitwiseOR(first.bitwiseAND(half))

    def product(x: Column, y: Column) -> Column:
        """x * y modulo 2^32, of halves."""
        upper = (bits(x, 16) * y).bitwiseAND(half)
        return x.bitwiseAND(half) * y + F.shiftleft(upper, 16)

    new_hi = (bits(second, 16) + product(hi, low).bitwiseAND(F.lit(LOW)) + product(lo, top).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
    return new_hi, new_lo


def jumps(key: Column, most: int) -> Column:
    """The jumps of a 64-bit key below ``most`` shards, in ascending order from 0."""
    begin = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(0).cast("long").alias("jump"), F.array().cast("array<long>").alias("seen"))

    def draw(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        drawn = F.struct(hi.alias("hi"), lo.alias("lo"))
        # the halves are needed twice: for the state and for the jump
        moved = F.transform(F.array(drawn), lambda d: F.struct(d["hi"].alias("hi"), d["lo"].alias("lo"), F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(d["hi"], 1) + 1).cast("double"))).alias("jump"), F.array_append(s["seen"], s["jump"]).alias("seen")))
        return F.when(s["jump"] < most, moved[0]).otherwise(s)

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, DRAWS))), begin, draw)
    if most <= DRAWS:
        return drawn["seen"]
    rest = F.sequence(F.lit(1), F.lit(most))
    goes_on = F.transform(F.array(drawn), lambda d: F.when(d["jump"] < most, F.aggregate(rest, d, draw)).otherwise(d))
    return goes_on[0]["seen"]


@tidy
def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"))
    narrow = narrow.select("*", jumps(F.col("key"), shards + 1).alias("seen"))
    shard = F.array_max(F.filter("seen", lambda j: j < shards)).cast("int")
    order = F.struct("shard", "doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("row"))
    rows = Settled(narrow.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.array_max("seen").cast("int").alias("grown_shard")).withColumn("order", order), "sharded")
    # one row a shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.df.groupBy("shard").agg(F.count("*").alias("rows")).select("shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    return ranked(rows.df, "order").join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), "grown_shard")
