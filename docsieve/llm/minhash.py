"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, connected components.

Two permutations of a fixed universe make all coordinates of a signature: the first places a shingle, the second, shifted
circularly by k places, gives its value for coordinate k. The K values of a shingle are thus one contiguous slice of the second permutation.

Identical shingle sets share one representative. Representatives that agree in a whole band meet in its bucket, and every link is
confirmed on the full sets (64-bit hashes of all shingles). A bucket is never paired with itself:

1. Each member is checked against one hub, the member of its buckets with most meetings. In a family of copies that is the text nearest to all
   others, and most members link to it: one check a member merges them, however large the family.
2. Only buckets that still hold several components go on. A member with so many shingles of its own (found in no other such member) that no partner
   could reach the similarity is left out, which is proof and no guess: two sets share at most what either shares with anybody.
3. Members outside the component of their bucket's hub meet the others of another component, in the lowest bucket that a pair shares; sizes, the shared shingles of
   both, and the low bits of all coordinates (within DEVIATIONS of the wanted similarity) are part of the join's condition. No bucket is capped.

Defined cases: null or wordless texts have an empty set, are linked with nothing and kept; fewer words than a shingle make
one shingle; equal texts are always linked; rows that repeat a doc_id each give a row of the result, with the same component when their sets
are equal, and different texts under one doc_id are linked each by its own set; an empty table gives no rows. Rows with a null doc_id are passed through as their own component (null) and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .components import components
from .store import Settled, arrow_batches, small

#: BANDS bands of ROWS coordinates: two sets of similarity 0.8 meet in no band with a chance of 1e-5.
ROWS = 7
BANDS = 48
#: All coordinates; the low bit of each tells how like two sets are, with a standard deviation of 0.02.
COORDINATES = 1024
UNIVERSE = 1 << 20
#: Standard deviations below the wanted similarity at which two members are no longer checked (a chance of 3e-6 to miss a pair right at it).
DEVIATIONS = 4.5


class Circulant:
    def __init__(self, seed: int = 20210907):
        rng = np.random.default_rng(seed)
        self.place = rng.permutation(UNIVERSE).astype(np.int32)
        values = rng.permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([values, values[:COORDINATES]])
        self.slices = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.place[(shingles >> np.uint64(20)) & np.uint64(UNIVERSE - 1)]
        out = np.full(COORDINATES, UNIVERSE, np.int32)
        for i in range(0, len(at), 256):
            np.minimum(out, self.slices[at[i : i + 256]].min(axis=0), out=out)
        return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a (sets x COORDINATES) array, from its first coordinates."""
    x = signature[:, : BANDS * ROWS].astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for j in range(ROWS):
        key = flat.mix(key * np.uint64(0xD1342543DE82EF95) + x[:, :, j])
    return key


def low_bits(signature: np.ndarray) -> np.ndarray:
    """The low bits of all coordinates, 64 in a word."""
    return np.packbits((signature & 1).astype(np.uint8), axis=1).view(np.uint64)


_circulant: list[Circulant] = []


def _sketch_batch(texts: pa.Array, words: int) -> pa.StructArray:
    if not _circulant:
        _circulant.append(Circulant())
    data, offsets = flat.flat(texts)
    n, first, second, keys, signs = [], [], [], [], []
    for low, high in flat.spans(offsets, flat.SPAN):
        at = offsets[low : high + 1]
        sets = flat.shingle_sets(data[at[0] : at[-1]], at - at[0], words)
        n += [len(s) for s in sets]
        first += [flat.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]
        second += [flat.mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for s in sets]
        signature = np.stack([_circulant[0].signature(s) for s in sets])
        keys.append(bands(signature))
        signs.append(low_bits(signature))
    def listed(parts: list[np.ndarray], width: int) -> pa.ListArray:
        values = np.concatenate(parts) if parts else np.zeros((0, width), np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), pa.array(values.ravel().view(np.int64)))

    longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([longs(n), longs(first), longs(second), listed(keys, BANDS), listed(signs, COORDINATES // 64)], ["n", "h1", "h2", "bands", "signs"])


def sketch(text: Column, words: int) -> Column:
    """struct<n, h1, h2, bands, signs>: size of the shingle set, 128 bits that name it, band keys, low bits of the signature."""

    def made(texts: pa.Array) -> pa.Array:
        return _sketch_batch(texts, words)

    return F.arrow_udf(made, "struct<n:long,h1:long,h2:long,bands:array<long>,signs:array<long>>")(text)


def shingles(text: Column, words: int) -> Column:
    """The sorted distinct shingles as 64-bit hashes."""

    def made(texts: pa.Array) -> pa.Array:
        data, offsets = flat.flat(texts)
        sets = []
        for low, high in flat.spans(offsets, flat.SPAN):
            at = offsets[low : high + 1]
            sets += flat.shingle_sets(data[at[0] : at[-1]], at - at[0], words)
        ends = np.cumsum([0] + [len(s) for s in sets])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))

    return F.arrow_udf(made, "array<long>")(text)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (columns a, b and others) with 100 * |A and B| >= percent * |A or B|, on the full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select(*pairs.columns)


def _near_size(m: str | Column, n: str | Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids with ``component``: the least id that each reaches over the links (a, b), its own without links."""
    return ids.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _to_hubs(buckets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, n, central): the rows of the buckets with their members' number of meetings; and the pairs (a, b) of each member and its hub."""
    central = buckets.groupBy("id").agg(F.sum("size").alias("central"))
    rows = buckets.select("key", "id", "n").join(central, "id")
    hubs = rows.groupBy("key").agg(F.max(F.struct("central", "id", "n")).alias("hub"))
    near = (F.col("id") != F.col("hub.id")) & _near_size(F.col("n"), F.col("hub.n"), percent)
    return rows, rows.join(hubs, "key").where(near).groupBy("id").agg(F.max("hub").alias("hub")).select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def _open(rows: DataFrame) -> DataFrame:
    """(key, id, n, component, outside): the rows of buckets with several components; outside: not of the component of the bucket's hub."""
    state = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("central", "id", "component")).alias("hub"))
    several = state.where("low != high").select("key", F.col("hub.component").alias("base"))
    return rows.join(several, "key").select("key", "id", "n", "component", (F.col("component") != F.col("base")).alias("outside"))


def _linkable(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open rows with ``shared``, the shingles of a member that others of them have too, where these suffice for a link."""
    each = sets.join(live.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("id").alias("id")).where("sets = 1").groupBy("id").agg(F.count("*").alias("alone"))
    shared = live.join(alone, "id", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return shared.where(100 * F.col("shared") >= percent * F.col("n"))


def _across(able: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be links, each made in the lowest bucket that it shares."""
    meetings = able.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    rows = able.join(meetings, "id").join(signs, "id")
    l, r = rows.where("outside").alias("l"), rows.alias("r")
    apart = (1 - percent / 100) / 2
    most = int(COORDINATES * (apart + DEVIATIONS * (apart * (1 - apart) / COORDINATES) ** 0.5))
    differ = sum((F.bit_count(F.get("l.signs", F.lit(i)).bitwiseXOR(F.get("r.signs", F.lit(i)))) for i in range(1, COORDINATES // 64)), F.bit_count(F.get("l.signs", F.lit(0)).bitwiseXOR(F.get("r.signs", F.lit(0)))))
    once = ~F.col("r.outside") | (F.col("l.id") < F.col("r.id"))
    enough = (100 + percent) * F.least("l.shared", "r.shared") >= percent * (F.col("l.n") + F.col("r.n"))
    lowest = F.get(F.array_intersect("l.keys", "r.keys"), F.lit(0)) == F.col("l.key")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") != F.col("r.component")) & once & _near_size(F.col("l.n"), F.col("r.n"), percent) & enough & (differ <= most) & lowest
    return l.join(r, on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.component").alias("ca"), F.col("r.component").alias("cb"))


def link(buckets: DataFrame, sets: DataFrame, signs: DataFrame, percent: int) -> Settled:
    """A table (id, component) over all ids of the buckets (key, id, n, size): the components of all confirmed links inside buckets."""
    rows, pairs = _to_hubs(buckets, percent)
    found = Settled(_verified(pairs, sets, percent), "links")
    component = Settled(_components(buckets.select("id").distinct(), found.df), "component")
    found.drop()
    live = Settled(_open(rows.join(component.df, "id")), "open")
    able = Settled(_linkable(live.df, sets, percent), "linkable")
    found = Settled(_verified(_across(able.df, signs, percent), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
    merged = _components(component.df.select(F.col("component").alias("id")).distinct(), found.df).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    whole = Settled(component.df.join(merged, "component").select("id", F.col("whole").alias("component")), "component")
    for old in (component, live, able, found):
        old.drop()
    return whole


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    arrow_batches(docs.sparkSession)
    mark = F.xxhash64("text")
    made = docs.select("doc_id", mark.alias("mark"), sketch(F.col("text"), words).alias("s"))
    sketched = Settled(made.select("doc_id", "mark", "s.n", "s.h1", "s.h2", F.when(F.col("s.n") > 0, F.col("s.bands")).alias("bands"), F.when(F.col("s.n") > 0, F.col("s.signs")).alias("signs")), "sketch")
    rows = Settled(sketched.df.select("doc_id", "n", "h1", "h2"), "rows")
    full = sketched.df.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # one representative for each distinct set, numbered, since a doc_id may stand for several sets; equal sets have equal bands
    distinct = full.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("bands").alias("bands"), F.first("signs").alias("signs"))
    groups = Settled(distinct.select("h1", "h2", "n", "least.doc_id", "least.mark", "bands", "signs", F.monotonically_increasing_id().alias("id")), "groups")
    sketched.drop()
    keys = groups.df.select(F.explode("bands").alias("key"), "id", "n")
    shared = Settled(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
    buckets = Settled(keys.join(small(shared.df), "key"), "buckets")
    shared.drop()
    members = Settled(groups.df.select("id", "doc_id", "mark").join(buckets.df.select("id").distinct(), "id", "left_semi"), "members")
    texts = docs.select("doc_id", mark.alias("mark"), "text").join(small(members.df), ["doc_id", "mark"])
    if repeats(rows.df):
        texts = texts.groupBy("id").agg(F.first("text").alias("text"))
    sets = Settled(texts.select("id", shingles(F.col("text"), words).alias("shingles")), "sets")
    whole = link(buckets.df, sets.df, groups.df.select("id", "signs"), percent)
    met = Settled(whole.df.join(groups.df.select("id", "doc_id", "h1", "h2", "n"), "id"), "met")
    least = met.df.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = groups.df.join(met.df, "id", "left_anti").select("h1", "h2", "n", F.col("doc_id").alias("component_id"))
    resolved = met.df.join(least, "component").select("h1", "h2", "n", "component_id").unionByName(alone)
    out = rows.df.join(resolved, ["h1", "h2", "n"], "left")
    own = F.coalesce("component_id", "doc_id")
    found = Settled(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")), "found")
    for old in (rows, groups, buckets, members, sets, whole, met):
        old.drop()
    return found.df


def repeats(rows: DataFrame) -> bool:
    """Whether a doc_id stands in several rows."""
    return not rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one document of each group of near-duplicates (five words, 0.8), all columns as they were.

    Where a doc_id stands in several rows, its different texts are documents of their own; of rows with one doc_id and text one stays, the same in
    each run. Rows with a null doc_id all stay.
    """
    if not repeats(docs):
        gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(small(gone), "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", mark.alias("mark")))
    found = near_duplicates(docs.select(own.alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select("doc_id.doc_id", "doc_id.mark").distinct().alias("g")
    named = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), "doc_id", mark.alias("mark"))
    left = named.join(gone, ["doc_id", "mark"], "left_anti")
    one = left.groupBy("doc_id", "mark").agg(F.min("row").alias("row")).select("row.*")
    return docs.where("doc_id is null").unionByName(one)
