"""The classifiers' arithmetic against plain computations on small inputs."""

import math
from collections import Counter

import numpy as np
import pytest

from formweave.llm import quality, toxicity


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, rng.integers(2, 7))).astype(np.uint32) for _ in range(14)]
    y = (rng.random(14) < 0.5).astype(np.int64)
    got = quality.fit(rows, y, mean_share=0.0, epochs=3000)
    p = 1.0 + np.sum([np.isin(np.arange(1 << quality.BITS), x) for x, t in zip(rows, y, strict=True) if t], axis=0)
    q = 1.0 + np.sum([np.isin(np.arange(1 << quality.BITS), x) for x, t in zip(rows, y, strict=True) if not t], axis=0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = np.array([[*(ratio[f] if f in r else 0.0 for f in range(12)), 1.0] for r in rows])
    sign = np.where(y > 0, 1.0, -1.0)
    # the dual by projected gradient, a step at a time
    kernel = (x @ x.T) * np.outer(sign, sign)
    dual = np.zeros(len(rows))
    for _ in range(200_000):
        dual = np.clip(dual + (1 - kernel @ dual) / np.linalg.norm(kernel, 2), 0, 1)
    w = (dual * sign) @ x
    assert got["b"] == pytest.approx(w[-1], abs=2e-3)
    assert got["w"][:12] == pytest.approx(w[:-1] * ratio[:12], abs=5e-3)


def test_long_words_differ_by_their_ends():
    assert quality.shape("a1" * 20 + "!") != quality.shape("a1" * 20 + "?") and quality.shape("ABC" + "x" * 50) == "aA"


def plain_score(text, model):
    restore = toxicity.Restorer(model["grams"])
    found = []
    for w in toxicity.words_of(text):
        marks = [m for x in restore(w) for m in toxicity.marks(x)]
        found.append(max((model["weights"].get(m, 0.0) for m in marks), default=0.0))
    x = [sum(found), max(found, default=0.0), len(found)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model["curve"], strict=False)) + model["curve"][3])))


def test_weights_and_scores(spark):
    good = ["the cat sat on the mat", "a quiet day in the town", "we read old books at night", "the river runs to the sea"]
    bad = ["you are a total moron today", "what a m0r0n you are", "such a m.o.r.o.n in town", "moron and the cat"]
    rows = [(i, good[i % 4] + f" {'abc'[i % 3]}") for i in range(60)] + [(100 + i, bad[i % 4] + f" {'abc'[i % 3]}") for i in range(60)] + [(300, None), (301, ""), (302, "MORON!! " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i < 300], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)

    import zlib

    restore = toxicity.Restorer(model["grams"])
    counts, total = (Counter(), Counter()), [0, 0]
    for i, text in rows:
        if i < 300 and zlib.crc32(str(i).encode()) % 5 != 0:
            words = toxicity.words_of(text)
            total[i >= 100] += len(words)
            for w in words:
                counts[i >= 100].update({m for x in restore(w) for m in toxicity.marks(x)})
    share = total[1] / sum(total)
    want = {}
    for m, n in counts[1].items():
        k = counts[0][m]
        ratio = math.log((n + 0.5) / (total[1] + 1)) - math.log((k + 0.5) / (total[0] + 1))
        gain = 2 * (n * math.log(n / ((n + k) * share)) + (k * math.log(k / ((n + k) * (1 - share))) if k else 0))
        if n > 2 and ratio >= 2 and gain >= 20:
            want[m] = ratio
    assert model["weights"] == pytest.approx(want) and "=moron" in want
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for i, text in rows:
        assert got[i].score == pytest.approx(plain_score(text or "", model), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.5)
    assert got[102].predicted == 1 and got[0].predicted == 0 and got[302].predicted == 1 and got[300].score == got[301].score
