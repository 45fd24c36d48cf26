"""Quality rules: base counts of a text, and cross-document line frequency, in DataFrame functions alone.

Lines are normalised (case, digits, white space) and hashed; each document counts once for each of its lines, per host (source). A line is above the limit
when more than ``LINE_DOCS`` documents of its host have it, however large the host. Such lines are
removed, and a document is rejected when they hold more than ``DEPLETED`` percent of its words.

Texts are read once: counts and hashed lines go to a written table of narrow rows. Lines are summed before the shuffle; only rows of a doc_id that stands
in several rows are first made distinct. The lines joined back are those above the limit.
Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; rows that share doc_id and text count as one
document with one verdict; a null doc_id is no document in the counts of lines; lines without words are no lines; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Settled, small

LINE_DOCS = 20
DEPLETED = 60
MIN_WORDS = 50
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words in order; none for a text without any."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare != "", F.split(bare, SPACES)).otherwise(F.array().cast("array<string>"))


def solid_chars(text: Column) -> Column:
    """Number of code points that are not white space of words."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.char_length(text).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def repeated_words(windows: Column) -> Column:
    """Number of words inside 3-word windows whose hash comes up twice or more; windows: the hash at each place.

    Places are sorted by hash, those with an equal neighbour are sorted again by place, and each adds what the one before does not cover.
    """
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # an array beside its shifts: neighbours without indexing
    n = F.size(windows)
    shifted = F.arrays_zip(order.alias("x"), F.concat(F.array(F.lit(None)), F.slice(order, F.lit(1), n - 1)).alias("p"), F.concat(F.slice(order, F.lit(2), n - 1), F.array(F.lit(None))).alias("q"))
    again = F.filter(shifted, lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda z: z["x"]["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(places, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))
    return total["n"]


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACES, " "))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, host, the base counts, and the hashed lines with their words of each row."""
    made = docs.select("doc_id", F.xxhash64(F.col("source").isNull(), "source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    made = made.select("doc_id", "host", words(F.col("text")).alias("w"), lines(F.col("text")).alias("l"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), solid_chars(F.col("text")).alias("word_chars"))
    n = F.size("w").cast("long")
    three = F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")), F.slice("w", F.lit(3), F.size("w")))
    windows = F.when(F.size("w") >= 3, F.transform(F.slice(three, F.lit(1), F.size("w") - 2), lambda z: F.xxhash64(z["w"], z["1"], z["2"])))
    hashed = F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD + "+")).alias("words")))
    made = made.select("doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("windows"), hashed.alias("lines"))
    some = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    made = made.withColumn("n_repeat_words", F.when(some, repeated_words(F.col("windows"))).otherwise(F.lit(0)).cast("long")).drop("windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.withColumn("base_failed", failed)


def frequent(rows: DataFrame, least: int = LINE_DOCS) -> DataFrame:
    """(host, line) that more than ``least`` documents of the host have; rows: a written table as ``base`` makes it."""
    named = rows.where("doc_id is not null").select("doc_id", "host", F.array_distinct("lines.line").alias("lines"))
    again = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    each = named.select("host", F.explode("lines").alias("line"))
    if not again.isEmpty():
        repeated = Settled(again, "repeated")
        ids = small(repeated.df)
        several = named.join(ids, "doc_id", "left_semi").select("host", "doc_id", F.explode("lines").alias("line")).distinct().select("host", "line")
        each = named.join(ids, "doc_id", "left_anti").select("host", F.explode("lines").alias("line")).unionByName(several)
    return each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least).select("host", "line")


def judge(docs: DataFrame, least: int = LINE_DOCS, depleted: int = DEPLETED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs."""
    rows = Settled(base(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    common = Settled(frequent(rows.df, least), "common")
    hit = rows.df.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words").join(small(common.df), ["host", "line"])
    lost = hit.groupBy("row").agg(F.sum("words").alias("lost"))
    joined = rows.df.drop("lines", "host").join(lost, "row", "left")
    empty = 100 * F.coalesce("lost", F.lit(0)) > depleted * F.col("n_words")
    found = Settled(joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~empty).alias("kept")), "judged")
    rows.drop()
    common.drop()
    return found.df
