"""Toxicity: class-conditional Kneser-Ney models.

A bigram model of toxic and one of ordinary text, smoothed by absolute discounting. A word's probability after the one before it is its discounted
count there; what the discount leaves over goes to the class's continuation probability, made of the number of different contexts that the class has
the word in; and what that leaves over goes to backoff counts that both classes share (all that the discounts took, and one for words not seen).
An expression has the class's own counts by the weight of evidence that the classes differ in it (a likelihood ratio against FACTOR), and
otherwise the counts of both classes together, tilted as its word's continuation is: a rare expression, a topic or a language doesn't sway a score.
Probabilities after each word sum to 1 in both classes. A text's score is a logistic curve over the mean of its words' log-likelihood
ratios. Counts are numbers of training documents with the bigram, so one repetitive text can't sway them.

Training reads the whole texts of a bounded sample (``PER_CLASS`` rows of each label).
Defined cases: null and empty texts have ratio 0 and get the curve's value there; equal texts get equal scores; an empty
table gives no rows; without training rows of both labels every score is 0.5. ASCII case is folded; bytes that are neither letters, digits nor above 127 end a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat, sample
from .nbsvm import logistic
from .store import arrow_batches

PER_CLASS = 3000
THRESHOLD = 0.7
#: Taken from each count of documents, and of contexts, for the lower order.
DISCOUNT = 2.0
#: Ratio of a word's probabilities in two classes that topic and language explain, and the statistic beyond it that has even weight.
FACTOR = 3.0
SURE = 8.0
#: Added to the number of words that divides the log-likelihood ratio: a few words are weak evidence.
EASE = 20
_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


def _events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's bigram, of the word before it (0 at a text's start) and of the word, and each row's first word."""
    folded = _FOLD[data]
    starts, ends, first = flat.words(folded, offsets)
    word = flat.hashes(folded, starts, ends)
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return flat.mix(before * np.uint64(0xD1342543DE82EF95) + word), before, word, first


@dataclass
class Table:
    """Values (classes x keys) by sorted key; what is not there has ``other``."""

    keys: np.ndarray
    values: np.ndarray
    other: np.ndarray

    def at(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(self.other[:, None], (len(self.other), len(h)))
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[place] == h, self.values[:, place], self.other[:, None])

    def without(self, plain: np.ndarray) -> Table:
        """The table less the keys that ``plain`` marks."""
        return Table(self.keys[~plain], self.values[:, ~plain], self.other)


@dataclass
class Model:
    gain: Table  # by bigram: its discounted probability after the word before
    left: Table  # by word before: what the discounts there leave over
    lower: Table  # by word: its continuation probability in the class
    slope: float = 0.0
    shift: float = 0.0

    def probabilities(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each word after the one before it, in ordinary and in toxic text."""
        return self.gain.at(pair) + self.left.at(before) * self.lower.at(word)

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each row, by length."""
        out = np.zeros(len(offsets) - 1)
        for low, high in flat.spans(offsets, flat.SPAN):
            at = offsets[low : high + 1]
            pair, before, word, first = _events(data[at[0] : at[-1]], at - at[0])
            ordinary, toxic = np.log(self.probabilities(pair, before, word))
            out[low:high] = flat.row_sums(toxic - ordinary, first) / (np.diff(first) + EASE)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(*flat.flat(texts)) + self.shift, -50, 50)))


def _sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values (classes x events) over the events of each place."""
    return np.stack([np.bincount(place, weights=v, minlength=size) for v in values])


def _evidence(n: np.ndarray, total: np.ndarray, tilt: np.ndarray | float, sure: float) -> np.ndarray:
    """Weight from 0 to 1 that toxic and ordinary shares n / total differ by more than FACTOR from ``tilt``, the log-ratio told by the lower order."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(n[1] * total[0]) - np.log(n[0] * total[1])
        null = np.exp(np.clip(ratio, tilt - np.log(FACTOR), tilt + np.log(FACTOR))) * total[1] / total[0]
        toxic, under = n[1] / n.sum(axis=0), null / (1 + null)
        statistic = 2 * (np.where(n[1] > 0, n[1] * np.log(toxic / under), 0) + np.where(n[0] > 0, n[0] * np.log((1 - toxic) / (1 - under)), 0))
    return 1 / (1 + np.exp(np.clip((sure - statistic) / 2, -50, 50)))


def count_models(rows: list[tuple[str, int]], discount: float = DISCOUNT) -> Model:
    data, offsets = flat.flat(pa.array([t for t, _ in rows], pa.string()))
    links: list[list[np.ndarray]] = [[], []]
    for low, high in flat.spans(offsets, flat.SPAN):
        at = offsets[low : high + 1]
        pair, before, word, first = _events(data[at[0] : at[-1]], at - at[0])
        for r in range(low, high):
            a, b = first[r - low], first[r - low + 1]
            once = a + np.unique(pair[a:b], return_index=True)[1]
            links[int(rows[r][1])].append(np.stack([pair[once], before[once], word[once]]))
    if not all(sum(x.shape[1] for x in c) for c in links):
        none = np.zeros(0, np.uint64), np.zeros((2, 0))
        return Model(Table(*none, np.zeros(2)), Table(*none, np.ones(2)), Table(*none, np.ones(2)))
    every = np.concatenate([x for c in links for x in c], axis=1)
    ordinary = sum(x.shape[1] for x in links[0])
    del links
    pairs, first, place = np.unique(every[0], return_index=True, return_inverse=True)
    n = np.stack([np.bincount(place[part], minlength=len(pairs)) for part in (slice(ordinary), slice(ordinary, None))]).astype(float)
    del place
    heads, head = np.unique(every[1, first], return_inverse=True)
    words, word = np.unique(every[2, first], return_inverse=True)

    # continuation: contexts of a word in each class, then what the discounts took of both
    del every, first
    contexts = _sums(word, n > 0, len(words))
    total, taken = contexts.sum(axis=1, keepdims=True), np.minimum(contexts, discount)
    shared = taken.sum(axis=0) / (taken.sum() + 1)
    own = (contexts - taken) / total + taken.sum(axis=1, keepdims=True) / total * shared
    both = ((contexts - taken).sum(axis=0) + taken.sum() * shared) / total.sum()
    weight = _evidence(contexts, total, 0.0, SURE)
    lower = weight * own + (1 - weight) * both
    unseen = taken.sum() / (taken.sum() + 1) / total.sum()
    whole = lower.sum(axis=1, keepdims=True) + unseen
    lower = Table(words, lower / whole, unseen / whole[:, 0])

    # bigrams: documents that have a word after another in each class, and in both
    after = _sums(head, n, len(heads))
    tilt = lower.values / ((lower.values * total).sum(axis=0) / total.sum())
    own = (n - np.minimum(n, discount)) / np.maximum(after, 1)[:, head]
    both = np.maximum(n.sum(axis=0) - 2 * discount, 0) / after.sum(axis=0)[head] * tilt[:, word]
    weight = _evidence(n, np.maximum(after, 0.5)[:, head], np.log(tilt[1] / tilt[0])[word], 2 * np.log(len(pairs)))
    gain = weight * own + (1 - weight) * both
    # a tilt may ask for more than a word's followers have
    most = np.maximum(_sums(head, gain, len(heads)), 0.99)
    gain *= (0.99 / most)[:, head]
    left = Table(heads, 1 - _sums(head, gain, len(heads)), np.ones(2))
    gain = Table(pairs, gain, np.zeros(2))
    return Model(gain.without((gain.values < 1e-12).all(axis=0)), left.without((left.values > 1 - 1e-9).all(axis=0)), lower)


def fit(rows: list[tuple[str, int]]) -> Model:
    label = np.array([int(y) for _, y in rows], int)
    held = np.arange(len(rows)) % 4 == 0
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        return count_models([])
    model = count_models([r for r, h in zip(rows, held) if not h])
    ratio = model.ratios(*flat.flat(pa.array([r[0] for r, h in zip(rows, held) if h], pa.string())))
    slope, shift = logistic(ratio, label[held])
    # the curve comes from rows that the counts had not seen; the counts then take all rows
    model = count_models(rows)
    model.slope, model.shift = slope, shift
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn only from rows outside fold 1 of 3."""
    return fit(sample.joined_labels(docs, labels, "toxic", 3, 1, PER_CLASS))


def score(model: Model, text: Column) -> Column:
    shared = model

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.scores(texts), pa.float64())

    return F.arrow_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    arrow_batches(docs.sparkSession)
    model = train(docs, labels)
    out = docs.select("doc_id", (sample.remainder("doc_id", 3) == 1).alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
