"""Quality classifier: naive Bayes support vectors over word-shape n-grams.

A document's features are the indicators of its shape 1-, 2- and 3-grams.  The shape of a word
keeps letter case, digits and punctuation but not the letters, and tells whether the word repeats
the one before.  Indicators are scaled by their class log-count ratios; a linear model with hinge
loss is fitted to them by dual coordinate descent and pulled towards its mean weight.  A logistic
curve through the training margins turns margins into scores.
"""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, sample
from .store import bounded_batches
from .workers import held

BITS = 18
_FORMS = [(re.compile(r"[^\W\d_]+"), lambda m: "a" if m[0].islower() else "A" if m[0].isupper() else "Aa" if m[0][1:].islower() else "aA"),
          (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] + "+")]


def shape(word: str) -> str:
    """Letters by case, digits as 0, runs of one sign as the sign and a plus."""
    for pattern, form in _FORMS:
        word = pattern.sub(form, word)
    return word


class _Shapes(dict):
    """Remembers the hash of each word's shape, for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = zlib.crc32(shape(word).encode()) << 1
        if len(word) <= 64:
            self[word] = code
        return code


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers below ``2 ** BITS``; empty for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(held("shapes", _Shapes).__getitem__, words), np.uint64, len(words))
    h[1:] |= np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1).astype(np.uint64)
    a = np.uint64(0x9E3779B97F4A7C15)
    h = h * a
    h ^= h >> np.uint64(29)
    two = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[1:] * np.uint64(3)
    three = two[:-1] * np.uint64(0x94D049BB133111EB) + h[2:] * np.uint64(5)
    every = np.concatenate([np.unique(h), np.unique(two), np.unique(three)]) * a
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.uint32))


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, cost: float = 1.0, mean_share: float = 0.25, epochs: int = 30, seed: int = 7) -> dict:
    """Weights over features, bias, and the slope and offset of the score curve."""
    n = 1 << BITS
    if len(rows) == 0 or y.min(initial=1) == y.max(initial=0):
        prior = float(y.mean()) if len(rows) else 0.5
        return {"w": np.zeros(n, np.float32), "b": 0.0, "slope": 0.0, "offset": 4.0 * (prior - 0.5)}
    p, q = np.full(n, alpha), np.full(n, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    sign = np.where(y > 0, 1.0, -1.0)
    values = [np.append(ratio[x], 1.0) for x in rows]  # the last is the bias
    index = [np.append(x, n) for x in rows]
    square = np.array([v @ v for v in values])
    w, dual = np.zeros(n + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[index[i]] @ values[i]) - 1.0
            step = min(max(dual[i] - slope / square[i], 0.0), cost) - dual[i]
            if step:
                dual[i] += step
                w[index[i]] += step * sign[i] * values[i]
                worst = max(worst, abs(step) * square[i])
        if worst < 1e-3:
            break
    bias, w = w[n], w[:n]
    seen = np.unique(np.concatenate(rows)) if rows else np.zeros(0, int)
    w[seen] = (1 - mean_share) * w[seen] + mean_share * np.abs(w[seen]).mean() * np.sign(w[seen])
    weights = (w * ratio).astype(np.float32)
    margin = np.array([weights[x].sum(dtype=np.float64) + bias for x in rows])
    slope, offset = logistic(margin, y)
    return {"w": weights, "b": float(bias), "slope": slope, "offset": offset}


def logistic(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets, by Newton's method."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, 0.0
    for _ in range(60):
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        e, v = s - target, np.maximum(s * (1 - s), 1e-9)
        g = np.array([e @ margin + ridge * a, e.sum()])
        h = np.array([[v @ (margin * margin) + ridge, v @ margin], [v @ margin, v.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> dict:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["y", "x"])

    got = sample(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1, max_rows).mapInArrow(extract, "y int, x binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.x)))
    return fit([np.frombuffer(bytes(r.x), np.uint32) for r in got], np.array([r.y for r in got], np.int64))


def scorer(spark: SparkSession, model: dict):
    """A column function from text to score."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights: fixed size

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m = shared.value
        w, b = m["w"], m["b"]
        margin = np.array([w[features(t or "")].sum(dtype=np.float64) + b for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -40, 40))))

    return lambda text: score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Null texts score like empty ones.  A null doc_id counts as held out.  Without labels of both
    kinds every text has the share of label 1 (or 0.5) as its tendency.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, train(docs, labels, max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5, unchanged."""
    bounded_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, train(docs, labels, max_rows))
    return docs.filter(score(F.col("text")) >= 0.5)
