"""Token counts of a public tokenizer file: lengths only, encoded in batches inside Arrow functions.

Batches are bounded by bytes. Texts are split at safe boundaries: before ASCII white space that follows a character which is not white space, and
before a stop that follows an ASCII letter. No match of the tokenizer's pattern crosses or looks over these, so the pieces' counts add up to the text's, however long it is. Equal pieces of a batch are
encoded once, and a bounded memo keeps counts between batches.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); strings of special tokens inside a text are treated as the library
does by default; equal texts give equal counts; an empty table gives no rows. Tokenizers whose pieces depend on the
text around (no byte-level pre-tokenizer, prefix spaces, normalisers) get whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import arrow_batches

LIMIT = 1024
#: Bytes that are split and encoded at once.
PART = 4 << 20
#: Counts that a worker remembers, in each of two generations.
MEMO = 500_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46]] = True  # ! , .
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LATIN = np.zeros(256, bool)  # first bytes of two-byte characters, none of which is white space
_LATIN[0xC3:0xE0] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the pieces (rows' borders among them), and each row's first piece."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before = _SOLID[data[:-1]]
        before[1:] |= _LATIN[data[:-2]] & (data[1:-1] >= 0x80)
        cut[1:-1] = flat.SPACE[data[1:]] & before | _STOP[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    borders = np.flatnonzero(cut)
    return borders, np.searchsorted(borders, offsets)


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        splitter = told.get("pre_tokenizer") or {}
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or any(c.isspace() or c in "!,." for c in t["content"])) for t in told.get("added_tokens", []))
        self.splits = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True) and not told.get("normalizer") and plain
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def recall(self, piece: bytes) -> int | None:
        """The count of a piece that came up lately; what is used again outlives the old generation."""
        n = self.young.get(piece)
        if n is None and (n := self.old.get(piece)) is not None:
            self.young[piece] = n
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        return n

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.splits:
            return np.array(self.lengths([t or "" for t in texts.to_pylist()]), np.int64)
        data, offsets = flat.flat(texts)
        out = np.zeros(len(offsets) - 1, np.int64)
        for low, high in flat.spans(offsets, PART):
            at = offsets[low : high + 1] - offsets[low]
            out[low:high] = self._part(data[offsets[low] : offsets[high]], at)
        return out

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        borders, first = pieces(data, offsets)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(spans)
        kinds = coded.dictionary.to_pylist()
        known = [self.recall(k) for k in kinds]
        new = [i for i, n in enumerate(known) if n is None]
        for i, n in zip(new, self.lengths([kinds[i].decode() for i in new])):
            known[i] = self.young[kinds[i]] = n
        each = np.array(known, np.int64)[coded.indices.to_numpy()] if kinds else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        return total[first[1:]] - total[first[:-1]]


_counters: dict[str, Counter] = {}


def n_tokens(text: Column, path: str) -> Column:
    def counted(texts: pa.Array) -> pa.Array:
        if path not in _counters:
            _counters[path] = Counter(path)
        return pa.array(_counters[path].count(texts), pa.int64())

    return F.arrow_udf(counted, "long")(text)


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    arrow_batches(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.select("doc_id", size.alias("n_bytes"), n_tokens(F.col("text"), path or default_path()).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
