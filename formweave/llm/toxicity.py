"""Toxicity by noisy-channel deobfuscation.

Words are restored before they are judged: a word with leetspeak, separators or repeated letters
becomes a lattice of the characters it may stand for (a separator also for the end of a word), and Viterbi decoding takes the path that is cheapest
under a character trigram model (learned from all texts) and the costs of the channel.
Restored words and their beginnings are features.  Those that make up a clearly larger share of the
distinct words of toxic texts carry their log ratio as weight; a text's sum of weights, its largest
weight and the number of its words (as for Poisson rates) make its score on a logistic curve.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, sample
from .store import bounded_batches, written
from .workers import held

#: What a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs put between the letters of a word.
SPACERS = " .-_*~/,'"
COST_LEET, COST_SPACER, COST_REPEAT, COST_KEEP = 0.7, 0.2, 0.6, 6.0
LONGEST_PREFIX, SHORTEST_PREFIX = 8, 4

_AFTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿€£"
_BEFORE = "".join(c for c in _AFTER if c not in "$@€£")
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
_TWICE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"^\w(?:[.\-_*~/,']+\w){2,}$")
_PARTED = re.compile(r"[^\W_][.\-_*~/,']+[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")


def letter(ch: str) -> str:
    """``ch`` if the language model knows its kind (a to z and Latin letters up to U+017F), else ¤."""
    return ch if "a" <= ch <= "z" or "\u00df" <= ch <= "\u017f" else "¤"


def bare(word: str) -> str:
    """``word`` without punctuation at its edges; a first sign of leetspeak stays."""
    return word.rstrip(_AFTER).lstrip(_BEFORE)


def suspicious(word: str) -> bool:
    """Whether a lower-case word without edge punctuation may be disguised."""
    if _TWICE.search(word):
        return True
    if word.isalpha():
        return False
    return bool(_SPACED.match(word)) or bool(_SIGN.search(word) or _PARTED.search(word)) and bool(_LETTER.search(word))


class Channel:
    """Decodes disguised words under a character trigram model given as counts."""

    def __init__(self, grams: dict[str, float]):
        self.three = dict(grams)
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        ends: Counter = Counter()
        for g, n in grams.items():
            self.two[g[:2]] += n
            self.one[g[1:]] += n
            ends[g[2]] += n
        total = sum(ends.values()) or 1.0
        self.base = {c: n / total for c, n in ends.items()}
        self.pairs: Counter = Counter()
        for g, n in self.one.items():
            self.pairs[g[0]] += n
        self.prices: dict[str, float] = {}

    def price(self, context: str, ch: str) -> float:
        """Negative log probability of ``ch`` after two characters, interpolated over orders."""
        known = self.prices.get(context + ch)
        if known is not None:
            return known
        p1 = 0.9 * self.base.get(ch, 0.0) + 0.1 / 200
        p2 = (self.one.get(context[1] + ch, 0.0) + 5 * p1) / (self.pairs.get(context[1], 0.0) + 5)
        p3 = (self.three.get(context + ch, 0.0) + 5 * p2) / (self.two.get(context, 0.0) + 5)
        if len(self.prices) > 1_000_000:
            self.prices.clear()
        self.prices[context + ch] = price = -math.log(p3)
        return price

    def options(self, word: str, i: int) -> list[tuple[str, float]]:
        """What character ``i`` may stand for (empty: nothing, blank: the end of a word) and the
        channel's cost."""
        ch = word[i]
        out = []
        if ch in SPACERS:
            out += [("", COST_SPACER), (" ", 0.0)]
        elif ch in LEET:
            out += [(x, COST_LEET) for x in LEET[ch]]
            out.append((ch, COST_KEEP))
        else:
            out.append((ch, 0.0))
        if i and ch == word[i - 1] and ch not in SPACERS:
            out.append(("", COST_REPEAT))
        return out

    def step(self, context: str, ch: str) -> tuple[float, str]:
        """Price and next context of a restored character; a blank ends a word, and a second blank
        adds nothing."""
        if ch == " ":
            return (0.0 if context == "^^" else self.price(context, "$")), "^^"
        known = letter(ch)
        return self.price(context, known), context[1] + known

    def cost(self, text: str) -> float:
        """Cost of a restored text with its end."""
        total, context = 0.0, "^^"
        for ch in text:
            price, context = self.step(context, ch)
            total += price
        return total + self.price(context, "$")

    def decode(self, word: str) -> str:
        """The cheapest reading of ``word``; of equally cheap ones the first in alphabetical order
        of their last step.  Time and memory are linear in the length."""
        states: dict[str, tuple[float, int]] = {"^^": (0.0, -1)}
        back: list[tuple[int, str]] = []
        for i in range(len(word)):
            after: dict[str, tuple[float, int, str]] = {}
            for context, (cost, at) in states.items():
                for ch, channel in self.options(word, i):
                    to, total = context, cost + channel
                    if ch:
                        price, to = self.step(context, ch)
                        total += price
                    if to not in after or (total, ch) < (after[to][0], after[to][2]):
                        after[to] = (total, at, ch)
            states = {}
            for to, (total, at, ch) in after.items():
                back.append((at, ch))
                states[to] = (total, len(back) - 1)
        _, at = min((cost + self.price(context, "$"), at) for context, (cost, at) in states.items())
        out = []
        while at >= 0:
            at, ch = back[at]
            out.append(ch)
        return "".join(reversed(out))


def words_of(text: str) -> set[str]:
    """Distinct lower-case words; runs of three or more single characters become one word too."""
    words = text.lower().split()
    out = set(words)
    if len(words) > 2:
        single = np.fromiter(map(len, words), np.int32, len(words)) == 1
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a > 2 and len(set(words[a:b])) > 1:
                    out.add(" ".join(words[a:b]))
    return out


class Restorer:
    """The words that a word, or a run of single characters, may have been: each one of its decoded
    reading and all of them as one."""

    def __init__(self, grams: dict[str, float]):
        self.channel = Channel(grams)

    def __call__(self, word: str) -> list[str]:
        if " " not in word:
            word = bare(word)
            if not suspicious(word):
                return [word]
        parts = self.channel.decode(word).split(" ")
        return list(dict.fromkeys(filter(None, [*parts, "".join(parts)])))


def marks(word: str) -> list[str]:
    """Features of a restored word: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in range(SHORTEST_PREFIX, min(LONGEST_PREFIX, len(word)) + 1))] if word else []


def learn_grams(rows: DataFrame) -> dict[str, float]:
    """Trigram counts over the distinct plain words of each text of ``rows`` (null: empty); bounded
    by the alphabet, in each task and in all."""
    def count(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(set((text or "").lower().split()))
            for word, n in words.items():
                word = bare(word)
                if not word.isalpha():
                    continue
                padded = "^^" + "".join(map(letter, word)) + "$"
                for i in range(len(padded) - 2):
                    total[padded[i:i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    got = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: float(r.n) for r in got.collect()}


def learn_weights(rows: DataFrame, grams: dict[str, float], min_ratio: float = 2.0, min_gain: float = 20.0) -> dict[str, float]:
    """Log ratios of the features that make up a clearly larger share of toxic texts' words.

    Counts are of the distinct words of each text, over the whole sample, summed where the texts
    are; features below the two thresholds are dropped there too.  What comes back is bounded by the
    words of the sample.
    """
    shared = rows.sparkSession.sparkContext.broadcast(grams)

    def count(batches):
        import pyarrow as pa

        restore, known, bad, good, n = Restorer(shared.value), {}, Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for w in words:
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = list(dict.fromkeys(m for x in restore(w) for m in marks(x)))
                    (bad if y else good).update(known[w])
                n[y > 0] += len(words)
        keys = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *keys]), pa.array([n[1], *(bad[k] for k in keys)], pa.int64()), pa.array([n[0], *(good[k] for k in keys)], pa.int64())], ["mark", "bad", "good"])

    counts = rows.mapInArrow(count, "mark string, bad long, good long").groupBy("mark").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.filter("mark = ''")
    ratio = F.log((F.col("bad") + 0.5) / (F.col("nb") + 1.0)) - F.log((F.col("good") + 0.5) / (F.col("ng") + 1.0))
    # twice the log-likelihood gained by telling the two kinds of text apart
    both, share = F.col("bad") + F.col("good"), F.col("nb") / (F.col("nb") + F.col("ng"))
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0.0))
    strong = (counts.filter("mark <> '' AND bad > 2").crossJoin(F.broadcast(total.select(F.col("bad").alias("nb"), F.col("good").alias("ng"))))
              .select("mark", ratio.alias("ratio"), gain.alias("gain"))
              .filter((F.col("ratio") >= min_ratio) & (F.col("gain") >= min_gain)))
    return {r.mark: r.ratio for r in strong.collect()}


class Scorer:
    """Sum of weights, largest weight and number of a text's distinct words; words are remembered, up
    to a bound.

    A word counts by its strongest feature.
    """

    def __init__(self, grams: dict[str, float], weights: dict[str, float]):
        self.restore, self.weights = Restorer(grams), weights
        self.known: dict[str, float] = {}
        self.heads = {m[1:1 + SHORTEST_PREFIX] for m in weights}

    def weight(self, word: str) -> float:
        """The largest weight among the features of a word."""
        found = [x for x in self.restore(word) if x[:SHORTEST_PREFIX] in self.heads]
        return max((self.weights.get(m, 0.0) for x in found for m in marks(x)), default=0.0)

    def __call__(self, text: str) -> tuple[float, float, int]:
        if len(self.known) > 300_000:
            self.known.clear()
        words = words_of(text)
        for w in words.difference(self.known):
            self.known[w] = self.weight(w)
        found = list(map(self.known.__getitem__, words))
        return math.fsum(found), max(found, default=0.0), len(words)


def curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic coefficients of the sum, the largest weight, 100 words, and the offset, by Newton's
    method; more weight never lowers a score and more words never raise it."""
    x = np.concatenate([x / [1, 1, 100], np.ones((len(y), 1))], axis=1)
    target = np.where(y > 0, 0.99, 0.01)
    beta, ridge = np.zeros(4), np.array([1e-2, 1e-2, 1e-2, 1e-6])
    for _ in range(200):
        s = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (s - target) + ridge * beta
        h = (x * np.maximum(s * (1 - s), 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return [max(float(beta[0]), 0.0), max(float(beta[1]), 0.0), min(float(beta[2]), 0.0) / 100, float(beta[3])]


def _scorer(key, model: dict) -> Scorer:
    return held(key, lambda: Scorer(model["grams"], model["weights"]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> dict:
    """Character trigrams of all of ``docs``; weights and curve fit on at most ``max_rows`` labelled
    rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    rows = written(sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, max_rows).repartition(docs.sparkSession.sparkContext.defaultParallelism * 2), "toxicity-sample")
    grams = learn_grams(docs)
    weights = learn_weights(rows, grams)
    shared = rows.sparkSession.sparkContext.broadcast({"grams": grams, "weights": weights})

    def sums(batches):
        import pyarrow as pa

        score = Scorer(**shared.value)
        for batch in batches:
            s, m, n = zip(*map(score, batch.column(0).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s, pa.float64()), pa.array(m, pa.float64()), pa.array(n, pa.int64())], ["y", "s", "m", "n"])

    got = sorted(rows.mapInArrow(sums, "y int, s double, m double, n long").collect())  # four numbers for each of at most max_rows rows
    table = np.array(got, np.float64).reshape(-1, 4)
    y = table[:, 0]
    return {"grams": grams, "weights": weights, "curve": curve(table[:, 1:], y) if len(got) and y.min() != y.max() else [0.0, 0.0, 0.0, -2.0]}


def scorer(spark: SparkSession, model: dict):
    """A column function from text to score."""
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)  # bounded by the alphabet and the words of the sample

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m = shared.value
        total = _scorer(key, m)
        x = np.array([total(t or "") for t in texts], np.float64).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ m["curve"][:3] + m["curve"][3], -40, 40))))

    return lambda text: score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Null texts score like empty ones.  A null doc_id counts as held out.  Without labels of both
    kinds nothing is toxic.  Other columns are ignored.
    """
    score = scorer(docs.sparkSession, train(docs, labels, max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, unchanged."""
    score = scorer(docs.sparkSession, train(docs, labels, max_rows))
    return docs.filter(score(F.col("text")) < 0.5)
