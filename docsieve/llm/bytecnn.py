"""Language ID: a byte convolutional network in numpy.

Texts are cut into overlapping windows of ``WINDOW`` bytes that cover them whole. Filters of several widths slide over
byte embeddings, each keeps its maximum in a window, a softmax layer reads the maxima; a text's class is the one with the
largest mean log-probability of its windows, weighted by bytes. The filters of all widths lie in one kernel, so applying
the net to a batch of windows is a look-up, a matrix product and a maximum.

Training: Adam on windows of the whole texts of a bounded sample (about ``PER_CLASS`` rows of each language, within the bounds of ``sample``) outside the held-out fold.
Defined cases: a text that is null or has no letter is ``und`` with score 0; equal texts give equal results; an empty
table gives no rows; if no language can be learnt, every text is ``und``. Case of ASCII letters is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat, sample
from .store import arrow_batches

PER_CLASS = 400
WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBED = 8
OVERLAP = max(WIDTHS) - 1
#: A document whose language is less sure than this is rejected by the filtering stage.
LEAST = 0.4


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of each window, and the bytes that it is the first to cover."""
    step = WINDOW - OVERLAP
    n = -(-np.diff(offsets) // step)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + nth * step
    stop = offsets[1:][row]
    return row, start, np.minimum(start + WINDOW, stop), np.minimum(step, stop - start)


def cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bytes of windows in lower case, padded with 0."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], flat.LOWER[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8)


def spread(e: np.ndarray) -> np.ndarray:
    """For each place in a window the embeddings of the bytes that the widest filter sees there."""
    view = np.lib.stride_tricks.sliding_window_view(e, (max(WIDTHS), EMBED), axis=(1, 2))
    return view.reshape(len(e), WINDOW - OVERLAP, max(WIDTHS) * EMBED)


#: One kernel holds the filters of all widths; narrower ones have zeros beyond their width.
MASK = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)))
for _i, _w in enumerate(WIDTHS):
    MASK[: _w * EMBED, _i * FILTERS : (_i + 1) * FILTERS] = 1


@dataclass
class Net:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # as MASK
    bias: np.ndarray  # all filters
    dense: np.ndarray  # all filters x languages
    shift: np.ndarray

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = spread(self.embed[x]) @ self.kernel
        n = z.shape[1]
        while n > 1:  # halve the window until one maximum is left
            half = n // 2
            np.maximum(z[:, :half], z[:, n - half : n], out=z[:, :half])
            n -= half
        out = np.maximum(z[:, 0] + self.bias, 0) @ self.dense + self.shift
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language index and probability of each text; rows without bytes have index 0."""
        data, offsets = flat.flat(texts)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        weight = np.full(len(offsets) - 1, 1e-9)
        row, start, stop, size = windows(offsets)
        for i in range(0, len(row), 64):
            part = slice(i, i + 64)
            np.add.at(total, row[part], self.log_probs(cut(data, start[part], stop[part])) * size[part, None])
            np.add.at(weight, row[part], size[part])
        mean = total / weight[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return mean.argmax(axis=1), np.round(1 / p.sum(axis=1), 6)


def fit(rows: list[tuple[str, str]], steps: int = 500, batch: int = 128) -> Net | None:
    """Adam on balanced batches of windows; some are cut short, as short texts are."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    rng = np.random.default_rng(17)
    data, offsets = flat.flat(pa.array([t for t, _ in rows], pa.string()))
    row, start, stop, size = windows(offsets)
    of = np.array([languages.index(y) for _, y in rows])
    label = of[row]
    # a language, one of its texts, one of that text's windows: a long text counts as one
    n, opening = np.bincount(row, minlength=len(rows)), np.searchsorted(row, np.arange(len(rows)))
    groups = [g for k in range(len(languages)) if len(g := np.flatnonzero((of == k) & (n > 0)))]
    filters = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "kernel": MASK * rng.normal(0, (3 * EMBED) ** -0.5, MASK.shape), "bias": np.zeros(filters), "dense": rng.normal(0, 0.3, (filters, len(languages))), "shift": np.zeros(len(languages))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    each = np.arange(batch)
    for t in range(1, steps + 1 if groups else 0):
        text = np.array([rng.choice(groups[i]) for i in rng.integers(len(groups), size=batch)])
        pick = opening[text] + (rng.random(batch) * n[text]).astype(int)
        x, y = cut(data, start[pick], stop[pick]), label[pick]
        for i in np.flatnonzero(rng.random(batch) < 0.3):
            x[i, rng.integers(12, WINDOW) :] = 0
        seen = spread(p["embed"][x])
        z = seen @ p["kernel"]
        best = z.argmax(axis=1)  # batch x filters: where each filter has its maximum
        pre = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + p["bias"]
        hidden = np.maximum(pre, 0)
        q = hidden @ p["dense"] + p["shift"]
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[each, y] -= 1
        q /= batch
        back = (q @ p["dense"].T) * (pre > 0)
        peak = np.take_along_axis(seen, best[:, :, None], axis=1)
        g = {"dense": hidden.T @ q, "shift": q.sum(axis=0), "bias": back.sum(axis=0), "kernel": MASK * np.einsum("bf,bfk->kf", back, peak), "embed": np.zeros_like(p["embed"])}
        into = (back[:, :, None] * p["kernel"].T[None]).reshape(batch, filters, max(WIDTHS), EMBED)
        for j in range(max(WIDTHS)):
            np.add.at(g["embed"], x[each[:, None], best + j], into[:, :, j])
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Net(languages, **p)


def train(docs: DataFrame) -> Net | None:
    """Learn only from text and non-null lang outside fold 2 of 4."""
    rows = docs.where(sample.remainder("doc_id", 4) != 2).select("doc_id", "text", F.col("lang").alias("label"))
    return fit(sample.own_labels(rows, PER_CLASS))


def identify(net: Net | None, text: Column) -> Column:
    """struct<lang, score>."""
    kind = "struct<lang:string,score:double>"
    if net is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    model, names = net, np.array(net.languages, dtype=object)

    def named(texts: pa.Array) -> pa.Array:
        best, p = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(p, pa.float64())], ["lang", "score"])

    readable = text.isNotNull() & text.rlike(r"\p{L}")
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    return F.when(readable, F.arrow_udf(named, kind)(text)).otherwise(und)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    arrow_batches(docs.sparkSession)
    net = train(docs)
    found = identify(net, F.col("text"))
    out = docs.select("doc_id", (sample.remainder("doc_id", 4) == 2).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is sure enough, all columns as they were."""
    arrow_batches(docs.sparkSession)
    found = identify(train(docs), F.col("text"))
    return docs.where((found["lang"] != "und") & (found["score"] >= LEAST))
