"""Byte-level BPE encoding and decoding by a reduction tree.

A text is halved down to leaves, leaves are encoded, and neighbours are joined: only a window around the seam is encoded again, and it grows
until the tokens outside provably stand. Two proofs are used for each end of the window:

- a border, where the splitting pattern ends a match whatever stands around: white space after another character, or an ASCII
  symbol (not an apostrophe) after a letter or digit; tokens on either side are those of the whole text;
- inside a long run without borders (writing without spaces, encoded data) an edge between two tokens that merges leave as they are when these two
  stand alone: a sequence of tokens is the encoding of its bytes if every two neighbours are.

Where neither is found the window grows to the ends of both halves. Decoding concatenates the bytes of both halves up the tree.

Defined cases: a null text counts as empty and has no tokens; special tokens are never produced; equal texts give equal ids; an empty table gives no rows.
The borders hold for patterns of the kind of ``public_tokenizers.PATTERN`` (contractions, letters, digits, symbols, white space).
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import arrow_batches

#: Longest leaf, in code points (and ids, of decoding).
LEAF = 96
#: First width of the window on either side of a seam.
REACH = 24
_BORDER = re.compile(r"(?<=\S)[ \t\n\r]|(?<=[^\W_])[!-&(-/:-@\[-`{-~]")


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Tree:
    def __init__(self, ranks: str, pattern: str, leaf: int = LEAF, reach: int = REACH):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf, self.reach = leaf, reach
        self.codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.bytes = [b""] * (max(merges.values()) + 1)
        for token, rank in merges.items():
            self.bytes[rank] = token
        self.text = [str(i) for i in range(len(self.bytes))]
        #: Characters that begin in a token, and whether it begins with one.
        self.begun = [sum(b & 0xC0 != 0x80 for b in token) for token in self.bytes]
        self.whole = [token[:1] < b"\x80" or token[:1] >= b"\xc0" for token in self.bytes]
        self.stand: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.codec.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        left, right = self._encode(text, low, middle), self._encode(text, middle, high)
        if not _BORDER.match(text, middle):
            self._join(text, low, middle, high, left, right)
        else:
            left += right
        return left

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> None:
        """Make left the ids of both halves."""
        reach = self.reach
        while True:
            start, keep, firm = self._before(text, low, middle, left, reach)
            stop, skip, fixed = self._after(text, middle, high, right, reach)
            window = self.codec.encode_ordinary(text[start:stop])
            if (firm or self._stand(left[keep - 1], window[0])) and (fixed or self._stand(window[-1], right[skip])):
                del left[keep:]
                left += window
                left += right[skip:] if skip else right
                return
            reach *= 2

    def _before(self, text: str, low: int, middle: int, left: list[int], reach: int) -> tuple[int, int, bool]:
        """Start of the window, number of ids before it, whether these surely stand."""
        border = low
        for m in _BORDER.finditer(text, max(low + 1, middle - reach), middle):
            border = m.start()
        if border == low and low < middle - reach:
            n, keep = 0, len(left)
            while keep > 1:
                keep -= 1
                n += self.begun[left[keep]]
                if n >= reach and self.whole[left[keep]] and self._edge(text, middle - n):
                    return middle - n, keep, False
            return low, 0, True
        n, keep = middle - border, len(left)
        while n > 0:
            keep -= 1
            n -= self.begun[left[keep]]
        return border, keep if border > low else 0, True

    def _after(self, text: str, middle: int, high: int, right: list[int], reach: int) -> tuple[int, int, bool]:
        """Stop of the window, number of ids of the right half inside it, whether those behind surely stand."""
        m = _BORDER.search(text, middle, min(high, middle + reach))
        n, skip = 0, 0
        if m is None and middle + reach < high:
            while skip < len(right) - 1:
                n += self.begun[right[skip]]
                skip += 1
                if n >= reach and self.whole[right[skip]] and self._edge(text, middle + n):
                    return middle + n, skip, False
            return high, len(right), True
        border = high if m is None else m.start()
        while skip < len(right) and (n < border - middle or not self.whole[right[skip]]):
            n += self.begun[right[skip]]
            skip += 1
        return border, skip, True

    @staticmethod
    def _edge(text: str, at: int) -> bool:
        """Whether no white space and no contraction is near, so that a match goes on over the edge or ends there in any surroundings."""
        return not text[at - 1].isspace() and not text[at].isspace() and "'" not in text[max(0, at - 3) : at + 1]

    def _stand(self, one: int, two: int) -> bool:
        """Whether merges leave two neighbouring tokens as they are."""
        if (one, two) not in self.stand:
            if len(self.stand) > 1 << 15:
                self.stand.clear()
            self.stand[one, two] = self.codec._encode_single_piece(self.bytes[one] + self.bytes[two]) == [one, two]
        return self.stand[one, two]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.codec.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join([self.text[i] for i in ids]).encode()).hexdigest()


_trees: dict[tuple[str, str], Tree] = {}


def tree(ranks: str, pattern: str) -> Tree:
    """One tree for each Python worker."""
    if (ranks, pattern) not in _trees:
        _trees[ranks, pattern] = Tree(ranks, pattern)
    return _trees[ranks, pattern]


def encode(text: Column, ranks: str, pattern: str) -> Column:
    """array<int>: the ids of each text."""

    def encoded(texts: pa.Array) -> pa.Array:
        t = tree(ranks, pattern)
        return pa.array([t.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))

    return F.arrow_udf(encoded, "array<int>")(text)


def decode(ids: Column, ranks: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for; null ids count as none."""

    def decoded(lists: pa.Array) -> pa.Array:
        t = tree(ranks, pattern)
        return pa.array([t.decode(x.as_py() or []) for x in lists], pa.binary())

    return F.arrow_udf(decoded, "binary")(ids)


def encode_checked(text: Column, ranks: str, pattern: str) -> Column:
    """struct<ids, restored>: the ids of each text, and whether decoding them gives it back."""

    def encoded(texts: pa.Array) -> pa.Array:
        t, ids, restored = tree(ranks, pattern), [], []
        for x in texts:
            text = x.as_py() or ""
            got = t.encode(text)
            ids.append(np.array(got, np.int32))
            restored.append(t.decode(got) == text.encode())
        ends = np.cumsum([0] + [len(i) for i in ids])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(restored, pa.bool_())], ["ids", "restored"])

    return F.arrow_udf(encoded, "struct<ids:array<int>,restored:boolean>")(text)


def round_trip(text: Column, ranks: str, pattern: str) -> Column:
    """struct<n, ids, decoded>: number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes. The ids stay in the worker."""

    def digested(texts: pa.Array) -> pa.Array:
        t, n, ids, decoded = tree(ranks, pattern), [], [], []
        for x in texts:
            got = t.encode(x.as_py() or "")
            n.append(len(got))
            ids.append(t.digest(got))
            decoded.append(hashlib.sha256(t.decode(got)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n", "ids", "decoded"])

    return F.arrow_udf(digested, "struct<n:long,ids:string,decoded:string>")(text)


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    arrow_batches(docs.sparkSession)
    path, split = vocabulary() if ranks is None or pattern is None else (ranks, pattern)
    out = docs.select("doc_id", round_trip(F.col("text"), path, split).alias("r"))
    return out.select("doc_id", F.col("r.n").alias("n_tokens"), F.col("r.ids").alias("ids_sha256"), F.col("r.decoded").alias("decoded_sha256"))


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back, for every row of docs."""
    arrow_batches(docs.sparkSession)
    path, split = vocabulary()
    out = docs.select("doc_id", encode_checked(F.col("text"), path, split).alias("e"))
    return out.select("doc_id", F.size("e.ids").cast("long").alias("n_tokens"), "e.ids", "e.restored")
