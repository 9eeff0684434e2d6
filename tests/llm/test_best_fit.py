"""Supersteps need exactly the sequences of best-fit decreasing."""

import bisect
import random

import pytest

from formweave.llm import packing


def best_fit(sizes, cap):
    gaps, opened = [], 0
    for length in sorted(sizes, reverse=True):
        for _ in range(sizes[length]):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else cap
            opened += gap == cap
            bisect.insort(gaps, gap - length)
    return opened


def placed(sizes, cap):
    """How full each sequence is; items of a sequence must not overlap."""
    spans, plan = {}, sorted(packing.supersteps(sizes, cap))
    for k, (length, rank, seq, off) in enumerate(plan):
        end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else sizes[length]
        for i in range(end - rank):
            spans.setdefault(seq + i, []).append((off, off + length))
    for items in spans.values():
        items.sort()
        assert items[-1][1] <= cap and all(a[1] <= b[0] for a, b in zip(items, items[1:], strict=False))
    assert sum(map(len, spans.values())) == sum(sizes.values())
    return len(spans)


def test_used_gaps_are_filled_first():
    assert placed({60: 3, 20: 3, 13: 4}, 100) == best_fit({60: 3, 20: 3, 13: 4}, 100) == 3


@pytest.mark.parametrize("seed", range(60))
def test_as_many_sequences_as_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([30, 100, 2048])
    sizes = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.choice([3, 12, 60]))}
    assert placed(sizes, cap) == best_fit(sizes, cap)
