"""The Jaccard join's hot regions, rounds of Voronoi cells, blocks and names, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from formweave.llm import jaccard
from tests.llm.test_llm import brute_components, docs_of, near_copies


@pytest.mark.parametrize("how", [{"joined": 8, "hot": 1}, {"joined": 4, "bits": 5}])
def test_small_limits_change_nothing(spark, how):
    rows = near_copies(seed=7)
    got = jaccard.similar_components(docs_of(spark, rows), 4, 85, 100, **how)
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 4, 85, 100)


def test_an_id_with_several_texts_is_one_vertex(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (5, "u v w x y z"), (9, "u v w x y z"), (7, "q r s t u v")]
    got = jaccard.similar_components(docs_of(spark, rows))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 3), (3, 3), (9, 3), (7, 7)}


def sets_near(rng, n=240):
    """Sets near a few centres, some of which are at the edge of the threshold."""
    centres = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(3)]
    return [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.04, 0.08, 0.3]), rng.integers(0, 2**63, 200).astype(np.uint64), centres[i % 3])) for i in range(n)]


@pytest.mark.parametrize("joined", [6, 60])
def test_rounds_and_blocks_lose_no_pair(spark, joined):
    rng = np.random.default_rng(2)
    sets = sets_near(rng)
    comp = rng.integers(0, 40, len(sets))
    rows = [(1, i, len(s), 0, int(c), len(sets)) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]
    members = spark.createDataFrame(rows, "key long, sid long, n int, pos int, comp long, size long")
    cells = spark.createDataFrame([(i, jaccard.cells_of(s).tobytes()) for i, s in enumerate(sets)], "sid long, cells binary")
    lots = jaccard.LOTS if joined > 6 else [(0.0, 1.0)]
    got = {tuple(r) for lot in lots for df in jaccard.region_pairs(members, cells, 85, 100, lot, joined) for r in df.collect()}
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if comp[a] != comp[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            assert (a, b) in got


def test_lots_part_all_pairs():
    ids = np.random.default_rng(1).integers(-2**63, 2**63, 2000)
    h = np.concatenate([jaccard.lot_of(int(s), ids) for s in ids[:20]])
    assert h.min() >= 0 and h.max() < 1 and abs((h < 1 / 32).mean() - 1 / 32) < 0.01
    assert jaccard.lot_of(int(ids[0]), ids[1:2]) == jaccard.lot_of(int(ids[1]), ids[:1])


def test_full_counts_tell_nothing():
    some = np.arange(300, dtype=np.uint64)  # all in one cell
    assert jaccard.cells_of(some).max() == jaccard.FULL
    low, high = jaccard.shared_shares(jaccard.cells_of(some), np.zeros(jaccard.CELLS, np.uint8))
    assert (low, high) == (1, 1)


def test_rows_that_go_have_a_kept_partner(spark):
    rng = random.Random(3)
    rows = near_copies(seed=9) + [(None, "x y z a b"), (None, "entirely other words stand here"), (4000, "")]
    rng.shuffle(rows)
    kept = {(r.doc_id, r.text) for r in jaccard.distinct_documents(docs_of(spark, rows)).collect()}
    want = {i: c for i, _, c in brute_components(rows, 5, 4, 5)}
    assert {i for i, _ in kept if i is not None} == {i for i, c in want.items() if i is not None and i == c}
    assert sum(i is None for i, _ in kept) == 2


def test_members_without_a_partner_leave_large_regions(spark):
    rng = np.random.default_rng(5)
    rows = [(key, key * 1000 + i, int(n), int(pos)) for key in (1, 2) for i, (n, pos) in enumerate(zip(rng.integers(20, 4000, 400), rng.integers(0, 1200, 400), strict=True)) if pos < n]
    rows += [(3, 9001, 10, 9), (3, 9002, 500, 400)]  # a small region stays as it is
    got = {tuple(r) for r in jaccard.with_partners(spark.createDataFrame(rows, "key long, sid long, n int, pos int"), 4, 5).collect()}
    want = {x for x in rows if any(x[0] == y[0] and x[1] != y[1] and jaccard._may(x[1:], y[1:], 4, 5) for y in rows)}
    assert want | set(rows[-2:]) <= got <= set(rows)
    assert len(got) <= 1.1 * len(want) + 2 and len(want) < 0.6 * len(rows)


def test_regions_inside_earlier_ones_are_joined_there(spark):
    rng = random.Random(8)
    rows = []
    for sid in range(60):  # some n-grams in one order, with gaps
        held = [k for k in range(30) if rng.random() < 0.9][:rng.randint(3, 25)] if sid < 20 else rng.sample(range(100, 140), 5)
        rows += [(key, sid, 100, pos, sid) for pos, key in enumerate(sorted(held))]
    members = jaccard.open_regions(spark.createDataFrame(rows, "key long, sid long, n int, pos int, comp long"))
    meet = lambda rows: {(a.sid, b.sid, t) for _, of in itertools.groupby(sorted(rows, key=lambda r: r.key), lambda r: r.key) for a, b in itertools.permutations(list(of), 2) for t in (4, 20) if jaccard._may((a.sid, a.n, a.pos), (b.sid, b.n, b.pos), t, t + 1)}
    all_rows, rest = members.collect(), jaccard.outer_regions(members).collect()
    assert meet(rest) == meet(all_rows) and len(rest) < len(all_rows)


def test_a_split_that_parts_nothing_makes_no_copies(spark, monkeypatch):
    made, real = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, tag, *a: made.setdefault(tag, []).append(out := real(df, tag, *a)) or out)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(60)]  # the cells of long texts are all alike
    rows = [(1, i, len(s), 0, i, len(sets)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, sid long, n int, pos int, comp long, size long")
    cells = spark.createDataFrame([(i, jaccard.cells_of(s).tobytes()) for i, s in enumerate(sets)], "sid long, cells binary")
    jaccard.region_pairs(members, cells, 4, 5, joined=20)
    assert [df.count() for df in made["voronoi"]] == [60] and made["stuck-regions"][0].count() == 1
