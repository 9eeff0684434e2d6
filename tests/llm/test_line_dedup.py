"""Line dedup against a plain reading of its rules."""

import random
import re
from collections import Counter, defaultdict

import pytest

from formweave.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, line int, at int, docs long, place string, leaf string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "p", "l") for i, t in rows], SCHEMA)


def brute(rows, depth=2, min_docs=3):
    """Dropped line numbers of each distinct text."""
    lines = {t: [tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", x)) for x in t.split("\n")] for _, t in rows if t is not None}
    docs = defaultdict(set)
    for t, found in lines.items():
        for x in filter(None, found):
            docs[x].add(t)
    support = Counter()
    leaf = lambda x: (len(x), x[:depth])
    for x, held in docs.items():
        for k, w in enumerate(x):
            if w != "<*>":
                support[leaf(x), k, w] += len(held)
    template, members = {}, defaultdict(set)
    for x in docs:
        fixed = tuple(w if w != "<*>" and support[leaf(x), k, w] >= min_docs else None for k, w in enumerate(x))
        if 2 * sum(w is not None for w in fixed) >= len(x):
            template[x] = leaf(x), fixed
            members[leaf(x), fixed] |= docs[x]
    return {t: {k for k, x in enumerate(found) if x in template and len(members[template[x]]) >= min_docs} for t, found in lines.items()}


def expected(rows, **how):
    gone, out = brute(rows, **how), Counter()
    for i, t in rows:
        if t is None:
            out[(i, None, 0, 0)] += 1
            continue
        parts = t.split("\n")
        out[(i, "\n".join(x for k, x in enumerate(parts) if k not in gone[t]), len(parts), len(gone[t]))] += 1
    return out


def got(spark, rows, **how):
    out = line_dedup.line_dedup(table(spark, rows), **how)
    assert set(out.columns) == {*SCHEMA.replace(",", "").split()[::2], "n_dropped"}
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.3:
                lines.append(f"Page {rng.randint(1, 99)} of {rng.randint(1, 99)}")
            elif kind < 0.5:
                lines.append(f"Posted by {rng.choice(['Ann', 'Bo', 'Cy', 'Di', 'Ed'])} in the {rng.choice(['news', 'sport', 'arts'])} section")
            elif kind < 0.6:
                lines.append(rng.choice(["", "  ", "\t", "\r"]))
            else:
                lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))))
        rows.append((i, "\n".join(lines)))
    return rows + rows[:5] + [(None, rows[3][1]), (7, None), (None, None), (8, "")]


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"min_docs": 2, "depth": 1}), (4, {"min_docs": 5, "depth": 3})])
def test_against_brute_force(spark, seed, how):
    rows = made(seed)
    want = expected(rows, **how)
    assert got(spark, rows, **how) == want and any(n for _, _, _, n in want)


def test_long_passages_fields_and_copies(spark):
    rng = random.Random(9)
    passage = " ".join(f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60))
    long = " ".join("q" * 5 for _ in range(20_000))
    rows = [(i, f"{chr(97 + i) * 4} is only here\n{passage}\nOrder {i} shipped to {chr(65 + i) * 3} on 2020-01-{i}") for i in range(6)]
    rows += [(10 + i, "one text\nthat is copied whole") for i in range(9)] + [(30, long), (31, "kept\r\n\r\nalso kept\r\n")]
    found = got(spark, rows)
    assert found == expected(rows)
    by = {i: (t, n) for i, t, _, n in found}
    # the passage goes, so does the order line, whose number, name and date are fields; copies are one document
    assert by[0] == ("aaaa is only here", 2) and by[10] == ("one text\nthat is copied whole", 0) and by[30] == (long, 0) and by[31][1] == 0


def test_empty_table(spark):
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = line_dedup.line_dedup(table(spark, made(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
