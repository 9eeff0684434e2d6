"""Ids above 16 bits do not wrap."""

import numpy as np

from formweave.llm import huffman


def test_width_follows_the_largest_id():
    for top, width in ((65535, 2), (65536, 4), (100_000, 4)):
        texts = [[1, 2, top], [], [0]]
        got, wide = huffman.narrowed([np.array(t, "<u4").tobytes() for t in texts])
        assert wide == width and [huffman._wide(x, wide).tolist() for x in got] == texts


def test_more_than_65536_distinct_ids():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 100, 70_000)
    lengths = huffman.code_lengths(counts)
    assert (lengths > 0).all() and np.exp2(-lengths.astype(float)).sum() == 1
    code = huffman.Code(lengths)
    ids = rng.integers(0, 70_000, 1000)
    bits, marks = code.encode(ids, np.array([300, 1000]))
    for raw, mark, want in zip(bits, marks, (ids[:300], ids[300:]), strict=True):
        starts = np.frombuffer(mark, "<u4").astype(np.int64)
        n = np.minimum(len(want) - np.arange(len(starts)) * huffman.STEP, huffman.STEP)
        assert code.decode(raw, starts, n).tolist() == want.tolist()
