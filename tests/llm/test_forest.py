"""Nearest neighbours: repeated ids, extreme vectors, several lengths, clashing columns, recall and work."""

import numpy as np
import pytest

from formweave.llm import forest


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5, 3) for i, v in rows], "vec_id long, embedding array<double>, leaf int, tree int, score double, query_id int")


def found(spark, rows, **how):
    out = {}
    for r in sorted(forest.nearest(table(spark, rows), **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def brute(rows, every=50, k=5):
    unique = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q in sorted({i for i, _ in unique if i % every == 0}):
        best = {}
        for _, a in (x for x in unique if x[0] == q):
            for i, b in unique:
                if i != q and len(a) == len(b):
                    x, y = np.array(a), np.array(b)
                    s = float((x / np.abs(x).max()) @ (y / np.abs(y).max()) / (np.linalg.norm(x / np.abs(x).max()) * np.linalg.norm(y / np.abs(y).max())))
                    best[i] = max(best.get(i, -2.0), s)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def check(spark, rows, **how):
    got, want = found(spark, rows, **how), {q: x for q, x in brute(rows).items() if x}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_rows_that_repeat_an_id(spark):
    near, other = [1.0, 0.1, 0.0], [0.0, 1.0, 0.3]
    rows = [(50, [1.0, 0.0, 0.0])] + [(1, near)] * 7 + [(2, [0.9, 0.2, 0.0]), (3, [0.8, 0.3, 0.1]), (4, other), (9, [0.1, 0.9, 0.9]), (10, [0.2, 0.2, 0.9])]
    check(spark, rows)
    # one id with many vectors takes one place
    rows += [(7, [1.0, 0.001 * k, 0.0]) for k in range(12)] + [(50, [0.0, 0.0, 1.0]), (100, near), (100, near)]
    check(spark, rows)


def test_extreme_and_unequal_vectors(spark):
    rows = [(50, [1e-200, 2e-200]), (1, [3e-200, 1e-200]), (2, [1e200, 2e200]), (3, [1e300, -1e300]), (100, [1.0, 2.0, 3.0]), (4, [3.0, 2.0, 1.0]), (5, [1.0]), (150, [2.0])]
    check(spark, rows)


def test_no_rows(spark):
    assert found(spark, []) == {} and found(spark, [(50, [1.0, 2.0])]) == {} and found(spark, [(1, [1.0]), (50, [0.0])]) == {}


@pytest.mark.parametrize("n", [3000, 12_000])
def test_clusters_need_a_small_part_of_the_table(n):
    rng = np.random.default_rng(4)
    centre, spread = rng.normal(size=(100, 32)), rng.normal(size=(100, 4, 32)) * 0.3
    lot = rng.integers(0, 100, n)
    v = centre[lot] + np.einsum("ni,nij->nj", rng.normal(size=(n, 4)), spread[lot]) + rng.normal(size=(n, 32)) * 0.02
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    index = forest.Forest(unit[:3000], 6, 64, 5, 0.95)
    leaf = np.stack([t.assign(unit) for t in index.trees])
    hit = scanned = 0
    for i, cells in zip(range(60), index.search(unit[:60]), strict=True):
        seen = np.zeros(n, bool)
        for t, at in cells:
            seen |= leaf[t] == at
        far = 2 - 2 * unit @ unit[i]
        far[i] = np.inf
        hit += seen[np.argsort(far)[:5]].sum()
        scanned += seen.mean()
    assert hit / 300 >= 0.9 and scanned / 60 <= 0.25
