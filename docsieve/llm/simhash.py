"""Document fingerprints: SimHash, in DataFrame functions alone.

Terms are words with the word after them, weighted by length (long pairs say more than pairs of particles). A term's 128 hash bits vote, with its
weight, on the signs of 128 counters; counters share long sums, all in generated code, and no shuffle is needed beyond the one that brings texts
together by key. Likeness is the share of equal bits.

``search`` finds all fingerprints in a Hamming radius of queries: bits are cut into blocks, and for each choice of blocks a table keyed by
them (the permuted tables) brings together fingerprints that agree there; with radius + r blocks, any two within the radius agree in r of them.

Defined cases: a null text counts as empty; a text without words has the zero fingerprint; the last word is a term without a follower; equal texts have equal
fingerprints; the next document of the last is the first (of a single one: itself); rows that share a doc_id are ordered by a hash of their texts, and whole repeated rows
have one successor, the next different row; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Settled, small, tidy

BITS = 128
#: Hamming radius of the search, and the share of ids (those divisible by it) that ask.
RADIUS = 3
QUERIES = 100
#: Rows of a group of ids whose texts are sorted together.
GROUP = 20_000
#: Largest weight of a term, and terms whose votes fit seven bits (the highest counter must leave the sign alone).
HEAVIEST, CHUNK = 4, 31
#: Stands for a null id.
NONE = -(1 << 63)
_BYTES = 0x0101010101010101
_PAIR = 0x000000FF000000FF
_LOW = 0xFFFFFFFF


#: White space of words, as characters and as a pattern.
BLANKS, SPACES = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def terms(df: DataFrame, body: str) -> DataFrame:
    """df less ``body``, with pos and pair: struct<_words: word, 1: the word after it> for each word; one row with nulls for a text without words."""
    keep = [c for c in df.columns if c != body]
    bare = F.btrim(body, F.lit(BLANKS))
    words = df.select(*keep, F.when(bare != "", F.split(bare, SPACES)).alias("_words"))
    zipped = words.select(*keep, F.arrays_zip("_words", F.slice("_words", F.lit(2), F.size("_words"))).alias("_pairs"))
    return zipped.select(*keep, F.posexplode_outer("_pairs").alias("pos", "pair"))


def voted(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hi, lo: the signs of the votes of all terms (columns of ``terms``) of each key.

    Votes of up to CHUNK terms are counted in bytes, eight counters in a long; chunks are then summed with two counters in a long.
    """
    one, two = F.col("pair")["_words"], F.col("pair")["1"]
    size = F.length(one) + F.coalesce(F.length(two), F.lit(0))
    weight = F.when(one.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(HEAVIEST), F.shiftright(size, 2)))).cast("long")
    h = exploded.select(*keys, F.expr(f"coalesce(pos, 0) div {CHUNK}").alias("chunk"), weight.alias("w"), F.xxhash64(one, two).alias("a"), F.xxhash64(two, one, F.lit(1)).alias("b"))
    part = [F.sum(F.col("w") * F.shiftrightunsigned(name, i).bitwiseAND(F.lit(_BYTES))).alias(f"{name}{i}") for name in "ab" for i in range(8)]
    chunks = h.groupBy(*keys, "chunk").agg(F.sum("w").alias("w"), *part)
    whole = [F.sum(F.shiftrightunsigned(f"{name}{i}", 8 * j).bitwiseAND(F.lit(_PAIR))).alias(f"{name}{i}_{j}") for name in "ab" for i in range(8) for j in range(4)]
    total = chunks.groupBy(*keys).agg(F.sum("w").alias("w"), *whole)

    def signs(name: str) -> Column:
        bits = []
        for i in range(8):
            for j in range(4):
                c = F.col(f"{name}{i}_{j}")
                for count, bit in ((c.bitwiseAND(F.lit(_LOW)), 8 * j + i), (F.shiftrightunsigned(c, 32), 8 * j + 32 + i)):
                    bits.append(F.when(count * 2 > F.col("w"), F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0))).otherwise(F.lit(0)).cast("long"))
        while len(bits) > 1:
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
        return bits[0]

    return total.select(*keys, signs("a").alias("hi"), signs("b").alias("lo"))


def printed(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: str, lo: str, other_hi: str, other_lo: str) -> Column:
    apart = F.bit_count(F.col(hi).bitwiseXOR(F.col(other_hi))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(other_lo)))
    return 1 - apart / float(BITS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo of each row of docs (doc_id, text), rows that share a doc_id voting apart."""
    keyed = _keyed(docs)
    once = keyed.dropDuplicates(["id", "mark"])
    voted_ = voted(terms(once.select("id", "mark", "text"), "text"), ["id", "mark"])
    return keyed.select("doc_id", "id", "mark").join(voted_, ["id", "mark"]).select("doc_id", "hi", "lo")


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, agree: int = 2) -> DataFrame:
    """(hi, lo, query_hi, query_lo, distance): all pairs of a distinct fingerprint (hi, lo) of prints and one of queries at most ``radius`` bits apart.

    radius + agree blocks; each table holds the fingerprints keyed by ``agree`` blocks, so a bucket grows with the number of fingerprints over
    2 ** (bits of a key). Equal fingerprints are one row, whatever their number. Few queries are broadcast to the tables; many meet them by a shuffle.
    """
    blocks = radius + agree
    edge = [BITS * i // blocks for i in range(blocks + 1)]

    def tables(rows: DataFrame) -> DataFrame:
        bits = F.concat(F.lpad(F.bin("hi"), 64, "0"), F.lpad(F.bin("lo"), 64, "0"))
        cut = rows.select("hi", "lo").distinct().withColumn("bits", bits).select("hi", "lo", *[F.substring("bits", edge[i] + 1, edge[i + 1] - edge[i]).alias(f"b{i}") for i in range(blocks)])
        keys = F.array(*[F.xxhash64(F.lit(t), *[f"b{i}" for i in chosen]) for t, chosen in enumerate(combinations(range(blocks), agree))])
        return cut.select("hi", "lo", F.explode(keys).alias("key"))

    asked = Settled(tables(queries).select("key", F.col("hi").alias("query_hi"), F.col("lo").alias("query_lo")), "queries").df
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("query_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("query_lo")))
    t, q = tables(prints).alias("t"), small(asked).alias("q")
    met = t.join(q, (F.col("t.key") == F.col("q.key")) & (apart <= radius))
    return met.select("hi", "lo", "query_hi", "query_lo", apart.alias("distance")).distinct()


def within(prints: DataFrame, radius: int = RADIUS, agree: int = 2) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo, distance): all pairs of distinct fingerprints (hi, lo) at most ``radius`` bits apart, a before b."""
    before = (F.col("query_hi") < F.col("hi")) | ((F.col("query_hi") == F.col("hi")) & (F.col("query_lo") < F.col("lo")))
    pairs = search(prints, prints, radius, agree).where(before)
    return pairs.select(F.col("query_hi").alias("a_hi"), F.col("query_lo").alias("a_lo"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), "distance")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), and the key of a row: id (null ids first) and mark, a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(NONE)).alias("id"), F.xxhash64("text").alias("mark"))


def _groups(kinds: DataFrame) -> list[int]:
    """Quantiles of the ids that cut them into groups of like size: some for each shuffle partition, and of GROUP rows at most up to 32,768 groups."""
    n = min(32_768, max(4 * int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), kinds.count() // GROUP))
    cuts = kinds.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0]
    return sorted(set(cuts or []))


def _group(cuts: list[int], column: str) -> Column:
    """Number of cuts at or below an id, in two steps of about the square root of their number."""
    step = max(1, round(len(cuts) ** 0.5))
    array = lambda xs: F.lit(xs) if xs else F.expr("cast(array() as array<bigint>)")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col(column)))
    block = below(array([int(c) for c in cuts[::step]]))
    start = F.greatest(block - 1, F.lit(0)) * step
    return start + below(F.slice(array([int(c) for c in cuts]), start + 1, F.lit(step)))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, id, mark, n) of docs, and each kind of row with its text and the next one's: (g, id, mark, n, text, next_id, next_mark, next_text).

    Texts cross one shuffle, by group of ids; only the last row of a group meets the head of the next group by a join.
    """
    keyed = _keyed(docs)
    rows = Settled(keyed.select("doc_id", "id", "mark", F.char_length("text").cast("long").alias("n")), "rows").df
    kinds = Settled(rows.groupBy("id", "mark").agg(F.count("*").alias("copies")), "kinds").df
    cuts = _groups(kinds)
    texts = keyed.select("id", "mark", "text")
    if not kinds.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "mark"])
    heads = kinds.select(_group(cuts, "id").alias("g"), F.struct("id", "mark").alias("head")).groupBy("g").agg(F.min("head").alias("head"))
    ring = Window.orderBy("g")  # a row for each group
    follows = heads.select("g", F.coalesce(F.lead("head").over(ring), F.min("head").over(Window.partitionBy())).alias("head"))
    follows = Settled(follows.select("g", F.col("head.id").alias("id"), F.col("head.mark").alias("mark")), "heads").df
    first = Settled(texts.join(F.broadcast(follows), ["id", "mark"]).select("g", F.struct("id", "mark", "text").alias("head")), "firsts").df
    order = Window.partitionBy("g").orderBy("id", "mark")
    placed = texts.select(_group(cuts, "id").alias("g"), "id", "mark", "text")
    led = placed.withColumn("led", F.lead(F.struct("id", "mark", "text")).over(order))
    nexts = F.coalesce("led", "head")
    out = led.join(first, "g").select("g", "id", "mark", F.char_length("text").cast("long").alias("n"), "text", nexts["id"].alias("next_id"), nexts["mark"].alias("next_mark"), nexts["text"].alias("next_text"))
    return rows, out


@tidy
def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row of docs.

    n_near: distinct fingerprints of documents whose id is divisible by QUERIES within RADIUS of the row's own, itself included.
    """
    rows, pairs = with_next(docs)
    half = F.floor(F.col("n") / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), (F.col("n") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    both = pairs.select("g", "id", "mark", "next_id", "next_mark", "text", changed.alias("changed"))
    hashed = Settled(both.select("id", "mark", "next_id", "next_mark", F.sha2("changed", 256).alias("edited_sha256")), "hashed").df
    variants = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("changed").alias("body")))
    each = both.select("g", "id", "mark", F.explode(variants).alias("v")).select("g", "id", "mark", "v.kind", "v.body")
    prints = Settled(voted(terms(each, "body"), ["g", "id", "mark", "kind"]), "prints").df
    plain = prints.where("kind = 0").select("id", "mark", "hi", "lo")
    other = prints.where("kind = 1").select("id", "mark", F.col("hi").alias("edited_hi"), F.col("lo").alias("edited_lo"))
    nexts = plain.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo"))
    asked = plain.where((F.col("id") != NONE) & (F.pmod("id", F.lit(QUERIES)) == 0))
    near = Settled(search(plain, asked).groupBy("hi", "lo").agg(F.count("*").alias("n_near")), "near").df
    plain = plain.join(small(near), ["hi", "lo"], "left").select("id", "mark", "hi", "lo", F.coalesce("n_near", F.lit(0)).alias("n_near"))
    out = rows.join(hashed, ["id", "mark"]).join(plain, ["id", "mark"]).join(other, ["id", "mark"]).join(nexts, ["next_id", "next_mark"])
    return out.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", printed("hi", "lo").alias("fingerprint"), printed("edited_hi", "edited_lo").alias("edited_fingerprint"), likeness("hi", "lo", "edited_hi", "edited_lo").alias("near_edited"), likeness("hi", "lo", "next_hi", "next_lo").alias("near_next"), "n_near")
