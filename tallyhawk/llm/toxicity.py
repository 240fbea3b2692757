"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word is a bag of its hashed character n-grams, so an unseen misspelling or ending
shares most vectors with what was learnt. The vectors of a window of words are averaged
and go into a linear softmax; vectors and softmax are trained jointly in numpy. A text
takes the probability of its most toxic window, so a short insult in a long text counts
the same as alone; in training that window is chosen anew in every epoch. A word that
comes again within a window counts in the length but adds no second vector, so junk that
repeats one word gathers no evidence.

Fitting uses about ``rows`` labelled texts of each class, dealt by a hash of the id. One task
trains on them; the driver gets the model only, no text and none of what is derived from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhawk.llm.common import dealt, unused
from tallyhawk.llm.grams import word_grams

BITS = 17
WINDOW = 32
_LEAST, _MOST = 3, 5
_NOTHING = 1 << BITS  # a bucket whose vector stays zero


@dataclass(frozen=True)
class Model:
    """The trained net folded to one number per bucket, since average and softmax are linear."""

    weight: np.ndarray
    scale: float
    shift: float

    def score(self, text: str | None) -> float:
        sums, sizes, names = [], [], []
        for bucket, word, words in word_grams(text or "", _LEAST, _MOST, BITS):
            sums.append(np.bincount(word, self.weight[bucket], words))
            sizes.append(np.bincount(word, minlength=words))
            names.append(bucket[:words])
        best = _windows(np.concatenate(sums), np.concatenate(sizes), _before(np.concatenate(names)))[1] if sums else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -30, 30))))


def _before(word: np.ndarray) -> np.ndarray:
    """Where each word stood last before, -1 where it did not."""
    order = np.argsort(word, kind="stable")
    out = np.full(len(word), -1)
    again = word[order[1:]] == word[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


def _windows(sums: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[int, float]:
    """First word and mean of the window of ``WINDOW`` words (or all) with the highest mean, each word's sum counted once a window."""
    n = len(sums)
    w = min(WINDOW, n)
    # A word adds to the windows that begin after its last occurrence and reach it.
    at = np.arange(n)
    change = np.bincount(np.maximum(np.maximum(before + 1, at - w + 1), 0), sums, n + 1) - np.bincount(at + 1, sums, n + 1)
    sizes = np.concatenate(([0], np.cumsum(sizes)))
    mean = np.cumsum(change)[: n - w + 1] / np.maximum(sizes[w:] - sizes[:-w], 1)
    best = int(np.argmax(mean))
    return best, float(mean[best])


class _Slabs:
    """Arrays in blocks large enough to go back to the system after training; thousands of small ones would stay in a worker that lives on."""

    def __init__(self):
        self.left = np.empty(0, np.int32)

    def keep(self, a: np.ndarray) -> np.ndarray:
        if len(a) > len(self.left):
            self.left = np.empty(max(1 << 23, len(a)), np.int32)
        out, self.left = self.left[: len(a)], self.left[len(a) :]
        out[:] = a
        return out


class _Text:
    def __init__(self, text: str, slabs: _Slabs):
        buckets, sizes, names = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, w, k in word_grams(text, _LEAST, _MOST, BITS):
            sizes.append(np.bincount(w, minlength=k))
            names.append(b[:k])
            buckets.append(b[np.argsort(w, kind="stable")].astype(np.int32))
        self.bucket, self.size = slabs.keep(np.concatenate(buckets)), slabs.keep(np.concatenate(sizes))
        self.start = slabs.keep(np.concatenate(([0], np.cumsum(self.size))))
        self.before = slabs.keep(_before(np.concatenate(names)))

    def window(self, weight: np.ndarray) -> tuple[np.ndarray, float]:
        if not len(self.bucket):
            return self.bucket, 0.0
        at, mean = _windows(np.add.reduceat(weight[self.bucket], self.start[:-1]), self.size, self.before)
        upto = min(at + WINDOW, len(self.size))
        once = np.repeat(self.before[at:upto] < at, self.size[at:upto])
        return np.where(once, self.bucket[self.start[at] : self.start[upto]], _NOTHING), mean


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the held-out windows, by Newton's method."""
    unit = max(1e-6, float(np.abs(x).mean()))
    z, beta = np.stack([x / unit, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0] / unit), float(beta[1])


def train(texts: list[str], toxic: list[int], epochs: int = 14, dim: int = 8, rate: float = 0.3, seed: int = 11) -> Model:
    """Vectors and softmax by AdaGrad over the chosen windows; a fifth of the texts calibrates."""
    y = np.asarray(toxic, dtype=np.int64)
    size = 1 << BITS
    if len(set(toxic)) < 2:  # nothing to tell apart: the share of the one class seen, none if nothing was
        return Model(np.zeros(size, np.float32), 0.0, 30.0 if len(y) and y[0] else -30.0)
    slabs = _Slabs()
    docs = [_Text(t, slabs) for t in texts]
    rng = np.random.default_rng(seed)
    fit = rng.random(len(docs)) >= 0.2
    # First windows: by the log-odds of a bucket's document frequency in either class.
    seen = np.zeros((2, size))
    for d, label, use in zip(docs, y, fit, strict=True):
        if use:
            seen[label, np.unique(d.bucket)] += 1
    per = [max(1, int((fit & (y == c)).sum())) for c in (0, 1)]
    weight = np.log((seen[1] + 0.5) / (per[1] + 1)) - np.log((seen[0] + 0.5) / (per[0] + 1))
    weight = np.append(weight, 0.0)
    vectors = np.zeros((size + 1, dim))  # the softmax starts at random, so these move apart; what training never meets adds nothing
    out = rng.normal(scale=0.1, size=(dim, 2))
    bias = np.zeros(2)
    g_vec, g_out, g_bias = np.full(size + 1, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    balance = np.array([0.5 / (per[0] / sum(per)), 0.5 / (per[1] / sum(per))])
    for _ in range(epochs):
        chosen = [d.window(weight)[0] if use else None for d, use in zip(docs, fit, strict=True)]
        order = rng.permutation(np.nonzero(fit)[0])
        for s in range(0, len(order), 32):
            some = [k for k in order[s : s + 32] if len(chosen[k])]
            if not some:
                continue
            ids = np.concatenate([chosen[k] for k in some])
            lens = np.array([len(chosen[k]) for k in some])
            cut = np.concatenate(([0], np.cumsum(lens)[:-1]))
            mean = np.add.reduceat(vectors[ids], cut, axis=0) / lens[:, None]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = (p - np.eye(2)[y[some]]) * balance[y[some]][:, None]
            back = err @ out.T
            owner = np.repeat(np.arange(len(some)), lens)
            owner, ids = owner[ids != _NOTHING], ids[ids != _NOTHING]
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, (back[:, j] / lens)[owner], len(touched)) for j in range(dim)], axis=1)
            grad += 1e-6 * vectors[touched]
            d_out = mean.T @ err / len(some)
            d_bias = err.mean(axis=0)
            g_vec[touched] += (grad**2).mean(axis=1)
            g_out += d_out**2
            g_bias += d_bias**2
            vectors[touched] -= rate * grad / np.sqrt(g_vec[touched])[:, None]
            out -= rate * d_out / np.sqrt(g_out)
            bias -= rate * d_bias / np.sqrt(g_bias)
        weight = vectors @ (out[:, 1] - out[:, 0])
    held = ~fit if len(set(y[~fit])) == 2 else fit
    means = np.array([d.window(weight)[1] for d, use in zip(docs, held, strict=True) if use])
    scale, shift = _calibrate(means, y[held])
    return Model(weight[:size].astype(np.float32), scale, shift)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["id"])
    m = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()], "scale": [m.scale], "shift": [m.shift]})


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", rows: int = 1500, longest: int = 100_000
) -> Model:
    """A model of ``labels.toxic``, learnt from about ``rows`` documents of each class among those of ``learn``.

    Texts of more than ``longest`` characters are scored like any other but not learnt from,
    which bounds what the training task holds.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = F.lit(0.0)
    for r in known.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == r.toxic, rows / r["count"]).otherwise(share)
    marks = known.where(dealt(F.col("doc_id"), 5) < share).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int"))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= longest)
    # About 2 * rows marks, so the texts never move to meet them.
    got = source.join(F.broadcast(marks), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))  # of an id's differing texts the least
    model = got.coalesce(1).mapInArrow(_trained, "weight binary, scale double, shift double").collect()
    if not model:  # no text, so no task
        return train([], [])
    return Model(np.frombuffer(model[0].weight, np.float32), model[0].scale, model[0].shift)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability ``out`` of being toxic; a null or wordless text takes that of no evidence."""

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, of(F.col(text)))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or more."""
    score = unused(docs, "toxicity")
    return scored(docs, model, text, score).where(F.col(score) < threshold).drop(score)
