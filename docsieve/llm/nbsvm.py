"""Quality classifier: Naive Bayes support vectors.

n-gram indicators (bytes, and word shapes, hashed into a fixed table) are scaled by class log-count ratios; a linear
hinge-loss model on the scaled, unit-length vectors is fitted by dual coordinate descent, and a logistic curve over
held-back training rows, whose n-grams are not counted, turns its margin into a score. Fitting reads the whole texts of a bounded sample
(``PER_CLASS`` rows of each label), scoring every whole text.

Defined cases: null and empty texts have no n-grams and get the score of the empty vector (the intercept); equal texts
get equal scores; other columns are never read; an empty table gives no rows; without training rows of both labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat, sample
from .store import arrow_batches

#: Training rows of each label (the documented bound of the sample).
PER_CLASS = 2500
BITS = 17
THRESHOLD = 0.3
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>!=_~^{}[]@\\"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small code for each word: its kinds of characters, its length class, whether it repeats the word before."""
    starts, ends, first = flat.words(data, offsets)
    code = np.zeros(len(starts), np.uint64)
    for bit, (kind, least) in enumerate(((_SYMBOL, 1), (_UPPER, 1), (_UPPER, 2), (_LOWER, 1), (_DIGIT, 1))):
        total = np.concatenate([[0], np.cumsum(kind[data])])
        code |= (total[ends] - total[starts] >= least).astype(np.uint64) << np.uint64(bit)
    code |= np.minimum((ends - starts) // 6, 3).astype(np.uint64) << np.uint64(5)
    h = flat.hashes(flat.LOWER[data], starts, ends)
    code[1:] |= (h[1:] == h[:-1]).astype(np.uint64) << np.uint64(7)
    return code, first


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each row the buckets of its n-grams, repeats included."""
    x = data.astype(np.uint64)
    one = _bucket(x, 1 << 40)
    two = _bucket(x[:-1] << np.uint64(8) | x[1:], 1 << 41) if len(x) > 1 else one[:0]
    three = _bucket(x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:], 1 << 42) if len(x) > 2 else one[:0]
    shape, first = _shapes(data, offsets)
    s1 = _bucket(shape, 1 << 43)
    s2 = _bucket(shape[:-1] << np.uint64(8) | shape[1:], 1 << 44) if len(shape) > 1 else s1[:0]
    s3 = _bucket(shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:], 1 << 45) if len(shape) > 2 else s1[:0]
    for a, b, p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        yield (one[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 2)], s1[p:q], s2[p : max(p, q - 1)], s3[p : max(p, q - 2)])


@dataclass
class Model:
    #: Column 0: the weight of each bucket's indicator; column 1: its share of the squared length.
    table: np.ndarray
    slope: float
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        seen = np.zeros(len(self.table), bool)
        for low, high in flat.spans(offsets, flat.SPAN):
            at = offsets[low : high + 1]
            for i, parts in enumerate(grams(data[at[0] : at[-1]], at - at[0]), low):
                for p in parts:
                    seen[p] = True
                total, square = self.table[np.flatnonzero(seen)].sum(axis=0, dtype=np.float64)
                for p in parts:
                    seen[p] = False
                out[i] = total / np.sqrt(square) if square > 0 else 0.0
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(*flat.flat(texts)) + self.shift)))


def _descend(rows: list[np.ndarray], y: np.ndarray, values: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Dual coordinate descent for the hinge loss with L2 norm (each row a unit vector of ``values`` at its buckets)."""
    w, alpha, rng = np.zeros(len(values)), np.zeros(len(rows)), np.random.default_rng(5)
    unit = [values[r] / max(np.sqrt((values[r] ** 2).sum()), 1e-12) for r in rows]
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            step = y[i] * float(w[rows[i]] @ unit[i]) - 1
            new = min(max(alpha[i] - step, 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * unit[i]
                most, alpha[i] = max(most, abs(new - alpha[i])), new
        if most < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with targets drawn in from 0 and 1 so that it stays finite."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - target) + 1e-6 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[tuple[str, int]]) -> Model:
    size = 1 << BITS
    label = np.array([int(y) for _, y in rows], int)
    if len(set(label.tolist())) < 2:
        return Model(np.zeros((size, 2), np.float32), 0.0, 0.0)
    data, offsets = flat.flat(pa.array([t for t, _ in rows], pa.string()))
    sets = []
    for low, high in flat.spans(offsets, flat.SPAN):
        at = offsets[low : high + 1]
        sets += [np.unique(np.concatenate(p)) for p in grams(data[at[0] : at[-1]], at - at[0])]
    held = np.arange(len(rows)) % 5 == 0
    counts = np.ones((2, size))
    for r, y, h in zip(sets, label, held):
        if not h:  # the curve comes from rows that neither the ratios nor the weights have seen
            counts[y][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(label == 1, 1, -1)
    keep = np.flatnonzero(~held)
    w = _descend([sets[i] for i in keep], y[keep], ratio)
    model = Model(np.column_stack([w * ratio, ratio**2]).astype(np.float32), 1.0, 0.0)
    margin = model.margins(data, offsets)
    model.slope, model.shift = logistic(margin[held], label[held])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn only from rows outside fold 0 of 5."""
    return fit(sample.joined_labels(docs, labels, "quality", 5, 0, PER_CLASS))


def score(model: Model, text: Column) -> Column:
    shared = model

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.scores(texts), pa.float64())

    return F.arrow_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    arrow_batches(docs.sparkSession)
    model = train(docs, labels)
    out = docs.select("doc_id", (sample.remainder("doc_id", 5) == 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they were."""
    arrow_batches(docs.sparkSession)
    model = train(train_docs, labels)
    return docs.where(score(model, F.col("text")) >= THRESHOLD)
