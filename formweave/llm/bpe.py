"""Byte-level BPE by two tiers: a minimal perfect hash, then a heap over linked bytes.

A pre-token that is in the vocabulary is found by one probe of a minimal perfect hash (with a
comparison of its bytes, since any key lands somewhere).  Others are merged: the bytes form a linked
list, a heap holds the neighbouring pairs by rank and position, and the lowest is merged until no
pair has a rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memo, chunks
from .store import bounded_batches

_M = (1 << 64) - 1
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & _M
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: keys fall into as many buckets as there are keys;
    a bucket of several gets a displacement that sends them to free slots, a bucket of one (a
    negative displacement) names its slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            buckets.setdefault(h % n, []).append((h, i))
        self.displace, self.key_at, free = [0] * n, [-1] * n, set(range(n))
        for b, items in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(items) == 1:
                slots, d = [free.pop()], None
                free.add(slots[0])
            else:
                d = 0
                while True:
                    d += 1
                    slots = [_slot(h, d, n) for h, _ in items]
                    if len(set(slots)) == len(slots) and all(self.key_at[s] < 0 for s in slots):
                        break
            self.displace[b] = -slots[0] - 1 if d is None else d
            for s, (_, i) in zip(slots, items, strict=True):
                self.key_at[s] = i
                free.discard(s)

    def probe(self, key: bytes) -> int:
        """Number of the key that ``key`` would be; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n]
        return self.key_at[-d - 1 if d < 0 else _slot(h, d, self.n)]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, limit: int = 250_000):
        self.tokens, self.table, self.pattern, self.limit = tokens, PerfectHash(tokens), regex.compile(pattern), limit
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def _pair(self, a: int, b: int) -> int:
        """Rank of two tokens joined, or -1."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = rank = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary as a whole."""
        ids = [self.byte[b] for b in data]
        n, pair = len(ids), self._pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank, ids[k])) >= 0:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := pair(ids[h], rank)) >= 0:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def pre_token(self, text: str) -> bytes:
        """Id bytes of one match of the pattern."""
        data = text.encode()
        at = self.table.probe(data)
        return array("I", [at] if self.tokens[at] == data else self.merge(data)).tobytes()

    def encode_many(self, texts: list[str], lead: str = "") -> list[bytes]:
        """Id bytes of ``lead + text`` for each text."""
        known, out = self.known, []
        for t in texts:
            got = []
            for w in self.pattern.findall(lead + t):
                x = known.get(w)
                if x is None:
                    if len(known) > self.limit:
                        known.clear()
                    x = self.pre_token(w)
                    if len(w) <= 40:
                        known[w] = x
                got.append(x)
            out.append(b"".join(got))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: list = [None, None]


def _loaded(key: str, tokens: list[bytes], pattern: str) -> tuple[Bpe, Memo]:
    if _LOADED[0] != key:
        coder = Bpe(tokens, pattern)
        _LOADED[:] = [key, (coder, Memo(coder.encode_many, limit=300_000))]
    return _LOADED[1]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Null text is empty: no ids, and the digests of nothing.  Each row of ``docs`` gives one row; null
    doc_ids stay null; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    tokens = read_ranks(ranks_path)
    key = hashlib.sha256(b"\0".join(tokens)).hexdigest() + pattern
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern))  # a vocabulary: fixed, under 1 MB

    def run(batches):
        import pyarrow as pa

        coder, memo = _loaded(key, *shared.value)
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in chunks(texts):
                for raw in memo.encode(texts[a:b]):
                    ids = np.frombuffer(raw, np.uint32)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)
