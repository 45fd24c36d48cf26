"""Spelling variants: the full neighbourhood of every vocabulary word, hash-joined to the vocabulary.

1. Runs of letters are counted in Arrow batches, one combined count a word and block; Spark sums the blocks. Words seen often enough are the vocabulary.
2. Every word emits all its distinct deletions, replacements and insertions over the observed alphabet. Each text is made once: a letter is deleted
   at the last place of its run, and inserted behind a run of itself. Candidates stream from two explodes into the join, nothing holds a neighbourhood.
3. A candidate that is a vocabulary word is near by construction; no distance is computed. Near words are counted and the largest kept before the shuffle.
4. Forms lead from word to word; counts grow along them by ``RATIO`` at least, so chains are short, and roots are found by doubling steps.

The vocabulary is broadcast to the candidates while its checked size allows (``store.small``) and met by a shuffle beyond. The alphabet, at most the
letters of the pattern, is the only thing that reaches the driver.

Defined cases: null and empty texts have no runs; a null doc_id hashes as the empty text, so its runs read ``:<run>``; rows that repeat a doc_id or a text count
each; of near words with equal counts the smallest in code-point order is the form; words may be any length; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Settled, arrow_batches, small

#: Runs of letters once A-Z are in lower case.
LETTERS = "a-zÀ-ÿ"
#: One run in so many loses a letter, by its hash.
DAMAGED = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form's count is at least so many times the word's.
RATIO = 5
#: Words of a block of counts, and of a task that makes candidates.
BLOCK_WORDS = 200_000
TASK_WORDS = 10_000


def _counted(batches: Iterator[pa.RecordBatch], least: int, damaged: int) -> Iterator[pa.RecordBatch]:
    # a damaged run is one letter shorter than it was, so shorter runs cannot make words
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    total: Counter[str] = Counter()

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            if not text.is_valid:
                continue
            start = zlib.crc32((f"{key.as_py()}:" if key.is_valid else ":").encode())
            # lower() of bytes changes A-Z alone
            for run, n in Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace"))).items():
                h = zlib.crc32(run.encode(), start)
                if h % damaged == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= least:
                    total[run] += n
            if len(total) >= BLOCK_WORDS:
                yield block()
                total.clear()
    yield block()


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, often: int = MIN_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that docs (doc_id, text) have ``often`` times or more."""
    arrow_batches(docs.sparkSession)
    blocks = docs.select("doc_id", "text").mapInArrow(lambda batches: _counted(batches, least, damaged), "word string, n long")
    return blocks.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def alphabet(words: DataFrame) -> list[str]:
    """The letters of the words; the pattern of runs allows fewer than a hundred."""
    return sorted(r["letter"] for r in words.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").distinct().collect())


def neighbourhood(words: DataFrame, letters: list[str]) -> DataFrame:
    """The columns of words and ``near``: every text one deletion, replacement or insertion away, each once a word."""
    length = F.char_length("word")
    placed = words.select("*", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    cut: dict[str, Column] = {"head": F.expr("left(word, at)"), "letter": F.expr("substr(word, at + 1, 1)"), "tail": F.expr("substr(word, at + 2)")}
    # the empty text in place of a letter is its deletion
    put = placed.withColumns(cut).select("*", F.explode(F.array(*[F.lit(x) for x in ["", *letters]])).alias("put"))
    put = put.where("put != letter AND (put != '' OR left(tail, 1) != letter)")
    made = F.array(F.concat("head", "put", "tail"), F.concat("head", "put", "letter", "tail"))
    both = put.select(*words.columns, "put", "letter", F.posexplode(made).alias("kind", "near"))
    return both.where("(kind = 0 AND letter != '') OR (kind = 1 AND put != '')").select(*words.columns, "near")


def near_words(words: DataFrame, count: int) -> DataFrame:
    """(word, n, n_near, form, form_n) of the words (word, n), ``count`` in number, that have near words."""
    letters = alphabet(words)
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_WORDS))
    known = small(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")))
    pairs = neighbourhood(words.repartition(tasks, "word"), letters).join(known, "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= RATIO * F.col("n")
    return found.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> Settled:
    """A table (word, root) of the links (word, form): forms followed to the last, twice as far in every round."""
    now = Settled(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.df.where("moved").isEmpty():
        onward = now.df.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = now.df.select("word", "root").join(onward, "root", "left")
        far = Settled(step.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        now.drop()
        now = far
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every vocabulary word of docs (doc_id, text)."""
    words = Settled(vocabulary(docs), "words")
    near = Settled(near_words(words.df, words.df.count()), "near")
    root = roots(near.df.where("form IS NOT NULL"))
    joined = words.df.join(near.df.drop("n"), "word", "left").join(root.df.drop("moved"), "word", "left")
    found = Settled(joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "variants")
    for old in (words, near, root):
        old.drop()
    return found.df
