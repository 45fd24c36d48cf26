"""LM scoring: cross-entropy difference of a target and a background model of word bigrams.

Both models count every word and word bigram of their texts: the background of all texts of the table, the target of those labelled good and not
toxic. They share one vocabulary, all words of the table as they are written (case, digits, punctuation and every byte). A word's
probability after the one before is its bigram count smoothed by its word count and that by a uniform share of the vocabulary (Dirichlet weights
``PRIOR``); the end of a text counts as a word, so each context's probabilities sum to 1. A document's score is the mean over its words of target
loss less background loss, in bits: lower is closer to the target. Both models have counted the documents that they score where these are theirs;
``loss_rest`` is the background's loss without the document's own counts: what the rest of the corpus knows of it.

The counts are a written table that grows with the corpus. Texts are packed into blocks by a pass over the scan (no shuffle); each block's distinct
n-grams (hashes) go with their counts to the bucket of their hash, are summed there over all blocks, and the sums go back to the blocks that
asked. Blocks and buckets grow in number and not in size, and only three sums reach the driver. Of an n-gram 48 bits of hash travel: at 1e11 distinct
n-grams about 0.04 percent share theirs with another and are counted together, at 1e13 about 3.5 percent.

Defined cases: null and wordless texts have no scored word, losses and score 0; equal texts get equal scores; an empty table gives no rows; without target rows both models are the background.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import Settled, arrow_batches, small, tidy

#: Bytes of text in a block, and in the share of the corpus whose n-grams meet in a bucket.
BLOCK = 2 << 20
#: Rows of a block, however short their texts.
BLOCK_ROWS = 50_000
#: Weight of the lower order, in counts.
PRIOR = 2.0
_END, _START = np.uint64(0x9E6C63D0876A9A35), np.uint64(0x3C79AC492BA7B653)
#: Low bits of a key that stay behind; the others name an n-gram within its bucket.
_CUT = np.uint64(16)
_LOW32 = np.uint64(32)


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each event's bigram, of the word before and of the word, and each row's first event; a row's last event is its end.

    Keys of words are even, those of bigrams odd. Rows without words have no events.
    """
    starts, ends, first = flat.words(data, offsets)
    h = flat.hashes(data, starts, ends)
    size = np.diff(first)
    size = size + (size > 0)
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.full(at[-1], _END, np.uint64)
    last = at[1:][size > 0] - 1
    inside = np.ones(at[-1], bool)
    inside[last] = False
    word[inside] = h
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[at[:-1][size > 0]] = _START
    pair = flat.mix(before * np.uint64(0xD1342543DE82EF95) + word)
    even = ~np.uint64(1)
    return pair | np.uint64(1), before & even, word & even, at


def _keys(pair: np.ndarray, before: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams' occurrences: bigrams, words with ends, and one start for each text with words; and each one's row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    some = np.flatnonzero(np.diff(at) > 0)
    start = np.full(len(some), _START & ~np.uint64(1), np.uint64)
    return np.concatenate([pair, word, start]), np.concatenate([row, row, some])


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the integers, plane by plane."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sent(keys: np.ndarray) -> np.ndarray:
    """What travels of keys: the high bits, in the same order, and the bit that tells words from bigrams."""
    return keys >> _CUT << np.uint64(1) | keys & np.uint64(1)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys the buckets, equal ranges of the key space, and where each begins."""
    bucket = (keys >> _LOW32) * np.uint64(buckets) >> _LOW32
    found, begins = np.unique(bucket, return_index=True)
    return found.astype(np.int64), np.append(begins, len(keys))


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys as the first one and differences, as many byte planes as these need."""
    step = np.diff(x)
    width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
    return x[:1].astype("<u8").tobytes() + bytes([width]) + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack_keys(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(b[8], -1)
    x = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    x[0] = np.frombuffer(b, np.uint8, 8)
    x[1:, : b[8]] = planes.T
    return np.cumsum(x.view("<u8").ravel(), dtype=np.uint64)


class Grams:
    """All n-gram occurrences of a block (``_keys``), sorted by key and, within a key, by row."""

    def __init__(self, every: np.ndarray, row: np.ndarray):
        self.order = np.argsort(every, kind="stable").astype(np.int32)
        key, of = every[self.order], row[self.order].astype(np.int32)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self.of = key[new], of
        #: Of each sorted occurrence the number of its key.
        self.number = np.cumsum(new, dtype=np.int32) - 1
        new[1:] |= of[1:] != of[:-1]
        self.same = np.flatnonzero(new).astype(np.int32)

    def per_occurrence(self, values: np.ndarray) -> np.ndarray:
        """The values of keys at the occurrences in their first order."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = values[self.number]
        return out

    def own(self) -> np.ndarray:
        """How often the row of each occurrence has its n-gram."""
        n = np.diff(np.append(self.same, len(self.order)))
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(n, n)
        return out


def _packed(ids: list, target: list, texts: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([len(t) for t in texts])
    columns = [[uuid.uuid4().int & (1 << 63) - 1], [ids], [target], [_pack(np.diff(ends, prepend=0))], [zlib.compress(b"".join(texts), 1)]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.bool_())), *(pa.array(c, pa.binary()) for c in columns[3:])], ["block", "ids", "target", "sizes", "texts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, target, sizes, texts): the rows (doc_id, text, target) in blocks of about BLOCK bytes and BLOCK_ROWS rows at most."""
    ids: list = []
    target: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        names, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        data, offsets = flat.flat(batch.column(1))
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if texts and (held + b - a > BLOCK or len(texts) == BLOCK_ROWS):
                yield _packed(ids, target, texts)
                ids, target, texts, held = [], [], [], 0
            ids.append(names[i])
            target.append(marks[i])
            texts.append(raw[a:b])
            held += b - a
    if texts:
        yield _packed(ids, target, texts)


def _opened(sizes: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's texts."""
    return np.frombuffer(zlib.decompress(texts), np.uint8), np.concatenate([[0], np.cumsum(_unpack(sizes).astype(np.int64))])


def _asked(buckets: int):
    """(bucket, block, keys, n, t) of each block: its distinct n-grams, their occurrences, and those in target texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = Grams(*_keys(*events(*_opened(r["sizes"], r["texts"]))))
                n = np.bincount(grams.number, minlength=len(grams.keys)).astype(np.uint64)
                t = np.bincount(grams.number, weights=np.array(r["target"], bool)[grams.of], minlength=len(grams.keys)).astype(np.uint64)
                found, begins = _dealt(grams.keys, buckets)
                sent, cut = _sent(grams.keys), [slice(i, j) for i, j in zip(begins[:-1], begins[1:])]
                columns = [pa.array(found, pa.int64()), pa.array([r["block"]] * len(found), pa.int64()), pa.array([_pack_keys(sent[c]) for c in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([_pack(x[c]) for c in cut], pa.binary()) for x in (n, t))], ["bucket", "block", "keys", "n", "t"])

    return made


def _summed(rows: pa.Table) -> pa.Table:
    """(bucket, block, n, t) of a bucket: the corpus counts of what each block asked; and its words, occurrences and target occurrences with block null."""
    keys = [_unpack_keys(b) for b in rows["keys"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = [np.bincount(place, weights=np.concatenate([_unpack(b) for b in rows[c].to_pylist()]), minlength=len(every)).astype(np.int64) for c in ("n", "t")]
    ends = np.cumsum([0] + [len(k) for k in keys])
    back = [[_pack(x[place[i:j]]) for i, j in zip(ends[:-1], ends[1:])] for x in total]
    bucket, none = rows["bucket"][0].as_py(), [None]
    counted = (every & np.uint64(1) == 0) & (every != _sent(_START & ~np.uint64(1)))
    sums = [int(counted.sum()), *(int(x[counted].sum()) for x in total)]
    parts = [pa.array([bucket] * (len(keys) + 1), pa.int64()), pa.array(rows["block"].to_pylist() + none, pa.int64())]
    parts += [pa.array(b + none, pa.binary()) for b in back]
    parts += [pa.array([None] * len(keys) + [x], pa.int64()) for x in sums]
    return pa.Table.from_arrays(parts, ["bucket", "block", "n", "t", "words", "all_n", "all_t"])


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: int | np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits of each event, from the counts of its bigram, of the word before and of the word."""
    lower = (word + PRIOR / vocabulary) / (total + PRIOR)
    return -np.log2((pair + PRIOR * lower) / (before + PRIOR))


def _scored(buckets: int, vocabulary: int, all_n: int, all_t: int):
    def made(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        (r,) = blocks.to_pylist()
        pair, before, word, at = events(*_opened(r["sizes"], r["texts"]))
        grams, size = Grams(*_keys(pair, before, word, at)), np.diff(at)
        found, begins = _dealt(grams.keys, buckets)
        count = np.zeros((2, len(grams.keys)), np.int64)
        for bucket, n, t in zip(*(counts[c].to_pylist() for c in ("bucket", "n", "t"))):
            k = int(np.searchsorted(found, bucket))
            count[0, begins[k] : begins[k + 1]], count[1, begins[k] : begins[k + 1]] = _unpack(n), _unpack(t)
        of, last = np.repeat(np.arange(len(size)), size), len(pair)
        heads = at[:-1][size > 0]

        def split(values: np.ndarray) -> list[np.ndarray]:
            """Of each event its bigram's, its word before's and its word's value, from those of all occurrences."""
            words = values[last : 2 * last]
            earlier = np.empty_like(words)
            earlier[1:] = words[:-1]
            earlier[heads] = values[2 * last :]
            return [values[:last], earlier, words]

        n = split(grams.per_occurrence(count[0]))
        bits = [losses(*n, all_n, vocabulary)]
        bits.append(losses(*split(grams.per_occurrence(count[1])), all_t, vocabulary) if all_t else bits[0])
        bits.append(losses(*(x - y for x, y in zip(n, split(grams.own()))), all_n - size[of], vocabulary))
        background, target, rest = (flat.row_sums(b, at) / np.maximum(size, 1) for b in bits)
        return pa.Table.from_arrays([blocks["ids"].combine_chunks().flatten(), *map(pa.array, (size, target, background, rest, target - background))], ["doc_id", "n_scored", "loss_target", "loss_background", "loss_rest", "score"])

    return made


@tidy
def differences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_scored (words and the end), loss_target, loss_background, loss_rest, score of every row of docs."""
    arrow_batches(docs.sparkSession)
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("q"), (F.max(F.coalesce("toxic", F.lit(1))) == 0).alias("t")).where("q and t")
    good = Settled(good.select("doc_id", F.lit(True).alias("target")), "target")
    marked = docs.select("doc_id", "text").join(small(good.df), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = Settled(marked.mapInArrow(_blocks, f"block long, ids array<{kind}>, target array<boolean>, sizes binary, texts binary"), "blocks").df
    good.drop()
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    asked = blocks.select("block", "target", "sizes", "texts").mapInArrow(_asked(parts), "bucket long, block long, keys binary, n binary, t binary")
    table = Settled(asked.groupBy("bucket").applyInArrow(_summed, "bucket long, block long, n binary, t binary, words long, all_n long, all_t long"), "grams").df
    vocabulary, all_n, all_t = (int(x or 0) for x in table.where("block is null").agg(F.sum("words"), F.sum("all_n"), F.sum("all_t")).first())
    counts = table.where("block is not null").select("block", "bucket", "n", "t")
    scored = blocks.select("block", "ids", "sizes", "texts").groupBy("block").cogroup(counts.groupBy("block"))
    return scored.applyInArrow(_scored(parts, max(vocabulary, 1), all_n, all_t), f"doc_id {kind}, n_scored long, loss_target double, loss_background double, loss_rest double, score double")
