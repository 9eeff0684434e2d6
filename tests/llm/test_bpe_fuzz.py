"""Byte-level BPE against the tiktoken library on many short texts of mixed white space."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from formweave.llm import bpe, pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "word", "don't", "we'll", "'", "42", "7", "é", "ñandú", "日本", "😀", "!", "...", "-", "\x00", "\x1c", " ", " ", "​", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r", "\r\n", "\x0b", "\x85", "q" * 45]


@pytest.fixture(scope="module")
def coders():
    tokens = bpe.read_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder = bpe.Bpe(tokens, public_tokenizers.PATTERN)
    return lib, coder, lambda limit=300_000: pieces.Memo(coder.encode_many, limit=limit)


def same(lib, coder, memo, texts):
    for text, raw in zip(texts, memo.encode(texts), strict=True):
        ids = np.frombuffer(raw, np.uint32)
        assert ids.tolist() == lib.encode_ordinary(text), repr(text)
        assert coder.decode(ids).decode() == text


def test_white_space_at_edges(coders):
    lib, coder, memo = coders
    same(lib, coder, memo(), ["", "a\nb\n", "a\nb ", "\na", "\n", " ", "a\n b", "a \nb", "a\n\nb ", "\nb\n", "x y\nz \n", "a\r\nb\r\n", " a\nb\t", "a\nb ", "\n b \n"])


@pytest.mark.parametrize("seed,limit", [(1, 300_000), (2, 300_000), (3, 50)])
def test_random_texts(coders, seed, limit):
    lib, coder, memo = coders
    rng, memo = random.Random(seed), memo(limit)
    for _ in range(80):
        same(lib, coder, memo, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(100)])
