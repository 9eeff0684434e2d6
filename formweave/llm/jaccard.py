"""Similarity self-join of documents on word n-grams: a metric-space join under Jaccard distance.

A document is the set of its distinct word n-grams; documents with equal sets form a class, and
classes join.  Jaccard distance is a metric on sets.

* Pivots of the first level.  Texts that share nothing are all at distance 1 from one another, so
  among drawn pivots nearly every text would lie in every window.  The first level
  therefore takes the singleton sets as pivots, under one global order of n-grams (rarest first,
  from a count sketch of the whole corpus): a class lies in the region of the first n-gram that it holds.
* Windows.  Classes within the threshold miss at most ``n - ceil(t n)`` of each other's n-grams, so
  a partner's region is among a class's first ``n - ceil(t n) + 1`` pivots:
  there the class is replicated.  Every pair of partners meets in a region, with a bound on
  sizes and positions that prunes most others.  Regions whose n-gram is frequent are dealt over
  runs, each with a leader, and the leaders join.
* Recursion.  A region first joins all its classes to one representative (by linear work, however
  large it is).  Members that sizes and positions bar from all others of a large region leave it, and a
  region inside an earlier one is joined there.  Regions that links have not made one component are then split by rounds, each
  a few joins of DataFrames: a region draws pivots from its members, a member goes to the
  nearest pivot and, by the triangle inequality, to every pivot within ``d(nearest) + 2 (1 - t)``.  Regions of
  few members, or of which a split would not spare half of the pairs, are joined exactly, in blocks of bounded size.  Distances there are those of
  hashed count vectors, under which no two sets are farther apart than their Jaccard distance.
  Pairs of large regions come in lots by a hash of the pair: the links of a lot make components before
  the next, and pairs inside a component are left out, so that a region of near copies, which the
  first lot joins, never gives all its pairs.
* Exactness.  Pairs that pass are verified on their whole sets; pairs inside a component found so
  far are not needed for components, all others are kept.  Class names are 64-bit digests; names
  that two sets share are found by a second digest, and those classes take it as their name.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, matched, shares_of, spread, without, written
from .workers import held

SKETCH_BITS, CELL_BITS, SMALL = 18, 9, 48
CELLS, FULL = 1 << CELL_BITS, 255
#: Members of a region that are joined as they are, and rows of a block of a larger one.
JOINED, BLOCK, RUN = 256, 1024, 4096
#: Lots of a large region's pairs, as shares of a pair's hash; regions of at most ``WHOLE`` members have one.
LOTS, WHOLE = ((0.0, 1 / 32), (1 / 32, 1 / 4), (1 / 4, 1.0)), 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; the whole sequence if shorter; none without words."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("words", _Words).__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    count = len(parts) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + count]) * _A
        out ^= out >> np.uint64(32)
        out *= _B
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Names:
    """Names of classes: the first digest (its lowest ``bits``), or the second where sets share the first."""

    def __init__(self, shared: frozenset = frozenset(), bits: int = 64):
        self.shared, self.mask = shared, (1 << (bits - 1)) - 1

    def first(self, digest: int) -> int:
        return digest if self.mask == (1 << 63) - 1 else digest & self.mask

    def __call__(self, s: np.ndarray) -> int:
        one, two = set_ids(s)
        one = self.first(one)
        return two if one in self.shared else one


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first pivots of a set of ``n`` may be a partner's region."""
    return n - -(-num * n // den) + 1


def cells_of(s: np.ndarray) -> np.ndarray:
    """Counts of a set's members by hash cell, up to ``FULL``."""
    return np.minimum(np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS), FULL).astype(np.uint8)


def _bucket(s: np.ndarray) -> np.ndarray:
    return ((s * _A) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def scan(docs: DataFrame, words: int, bits: int = 64) -> tuple[DataFrame, np.ndarray]:
    """One row per document (``doc_id``, ``n``, ``sid``, ``other``: its second digest), stored, and the
    sketch's levels."""
    share = 1 << (SKETCH_BITS - 4)

    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names, name = ["doc_id", "n", "sid", "other", "part", "counts"], Names(bits=bits)
        for batch in batches:
            n, sid, other, held, size = [], [], [], [], 0
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                one, two = set_ids(s)
                n.append(len(s))
                sid.append(name.first(one))
                other.append(two)
                held.append(s)
                size += len(s)
                if size > 500_000:
                    sketch += np.bincount(_bucket(np.concatenate(held)), minlength=len(sketch))
                    held, size = [], 0
            if size:
                sketch += np.bincount(_bucket(np.concatenate(held)), minlength=len(sketch))
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(other, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        parts = [sketch[i:i + share].astype("<i8").tobytes() for i in range(0, len(sketch), share)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    both = written(docs.mapInArrow(run, "doc_id long, n int, sid long, other long, part int, counts binary"), "sets")

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = both.filter(F.col("part").isNotNull()).select("part", "counts", F.pmod(F.xxhash64(F.md5("counts"), F.monotonically_increasing_id()), F.lit(16)).alias("some"))
    some = parts.groupBy("part", "some").applyInArrow(add, "part int, counts binary")
    total = some.groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # the sketch: fixed size
    counts = np.concatenate([np.frombuffer(bytes(r.counts), "<i8") for r in sorted(total)]) if total else np.zeros(1 << SKETCH_BITS, np.int64)
    return both.filter(F.col("part").isNull()).select("doc_id", "n", "sid", "other"), np.log2(counts + 1).astype(np.uint8)


def named_rows(rows: DataFrame, bits: int = 64, limit: int = 100_000) -> tuple[DataFrame, Names]:
    """Rows with the name of their class as ``sid``, and the naming.

    Names that several sets share are few (of ten billion sets some three pairs), which is checked.
    """
    pairs = rows.filter("n > 0").groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi")
    shared = [r.sid for r in pairs.select("sid").limit(limit + 1).collect()]
    if len(shared) > limit:
        raise ValueError("too many sets share a name")
    if not shared:
        return rows.drop("other"), Names(bits=bits)
    apart = rows.withColumn("sid", F.when(F.col("sid").isin(shared), F.col("other")).otherwise(F.col("sid")))
    if apart.filter("n > 0").groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").limit(1).count():
        raise ValueError("sets share both names")
    return written(apart.drop("other"), "named-sets"), Names(frozenset(shared), bits)


def regions(docs: DataFrame, words: int, num: int, den: int, levels: np.ndarray, name: Names, hot: int) -> DataFrame:
    """Each class in all its regions: ``key``, ``run``, ``sid``, ``n``, ``pos``.

    ``run`` is -1; regions whose n-gram occurs in clearly more than ``hot`` documents are dealt over runs from
    0, of about ``hot`` rows each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # fixed size
    shares, base = shares_of(docs.sparkSession), int(np.log2(hot))

    def run(batches):
        import pyarrow as pa

        level, seen = shared.value.astype(np.uint64) << np.uint64(58), set()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                if not len(s) or (sid := name(s)) in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(sid)
                p = prefix_length(len(s), num, den)
                order = level[_bucket(s)] | (s >> np.uint64(6))
                first = np.sort(np.partition(order, p - 1)[:p] if p < len(order) else order)
                many = (first >> np.uint64(58)).astype(np.int64) - base
                run = np.where(many > 0, sid % np.minimum(shares, 1 << np.clip(many, 0, 40)), -1).astype(np.int32)
                for c, x in zip(cols, (first.view(np.int64), run, np.full(p, sid, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)), strict=True):
                    c.append(x)
                size += p
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "run", "sid", "n", "pos"])
                    cols, size = ([], [], [], [], []), 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "run", "sid", "n", "pos"])

    return docs.mapInArrow(run, "key long, run int, sid long, n int, pos int")


def may_link(n1, n2, p1, p2, num: int, den: int):
    """Whether sets of these sizes that first meet at these positions can reach the threshold."""
    need = -(-num * (n1 + n2) // (num + den))
    return np.minimum(n1 - p1, n2 - p2) >= need


def _may(x: tuple, y: tuple, num: int, den: int) -> bool:
    """:func:`may_link` of two rows (sid, n, pos)."""
    return min(x[1] - x[2], y[1] - y[2]) >= -(-num * (x[1] + y[1]) // (num + den))


class _Region:
    """Joins a region's rows, which come one by one, to its first; holds at most ``SMALL`` of them.

    Of a region that is dealt over runs this sees one run: its first row is a leader, and all its
    rows are members.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.key, self.rows, self.large = num, den, None, [], False
        self.out: list[tuple] = []
        self.recent: set = set()

    def _pair(self, x: tuple, y: tuple) -> None:
        if (x[0], y[0]) not in self.recent and _may(x, y, self.num, self.den):
            if len(self.recent) > 200_000:
                self.recent.clear()
            self.recent.add((x[0], y[0]))
            self.out.append((0, self.key[0], x[0], y[0], 0, 0))

    def _member(self, x: tuple, kind: int = 1) -> None:
        self.out.append((kind, self.key[0], x[0], x[0], x[1], x[2]))

    def add(self, key: tuple, row: tuple) -> None:
        if key != self.key:
            self.close()
            self.key, self.rows, self.large, self.last = key, [row], key[1] >= 0, row[0]
            if self.large:
                self._member(row, 2)
                self._member(row)
            return
        if row[0] == self.last:
            return  # the same class from another task
        self.last = row[0]
        self._pair(self.rows[0], row)
        if self.large:
            self._member(row)
            return
        self.rows.append(row)
        if len(self.rows) > SMALL:
            for x in self.rows[1:]:
                self._member(x)
            self.rows, self.large = self.rows[:1], True

    def close(self) -> None:
        """Members that may have a partner besides the first row go to the recursion."""
        rest = self.rows[1:]
        if self.large or len(rest) < 2:
            return
        for i, x in enumerate(rest):
            if any(_may(x, y, self.num, self.den) for j, y in enumerate(rest) if j != i):
                self._member(x)


def first_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Joins every region's classes to its first one.  ``kind`` 0: a pair to verify; 1: a member that
    may have other partners in its region, for the recursion; 2: the leader of a run.  Regions
    stream by; none is held."""
    def run(batches):
        import pyarrow as pa

        region = _Region(num, den)

        def taken():
            cols = zip(*region.out, strict=True) if region.out else [()] * 6
            region.out = []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "key", "a", "b", "n", "pos"])

        for batch in batches:
            key, part, sid, n, pos = (c.to_numpy() for c in batch.columns)
            # only rows that share a key with a neighbour (or with the open region) or lie in a run matter
            same = np.flatnonzero(key[1:] == key[:-1])
            use = part >= 0
            use[same] = use[same + 1] = True
            if len(key):
                use[-1] = True
                if region.key is not None:
                    use |= key == region.key[0]
            for k, p, row in zip(key[use].tolist(), part[use].tolist(), zip(sid[use].tolist(), n[use].tolist(), pos[use].tolist(), strict=True), strict=True):
                region.add((k, p), row)
            yield taken()
        region.close()
        yield taken()

    return rows.repartition("key", "run").sortWithinPartitions("key", "run", "pos", "sid").mapInArrow(run, "kind int, key long, a long, b long, n int, pos int")


def leader_pairs(leaders: DataFrame, num: int, den: int) -> DataFrame:
    """Leaders of a region's runs (as many as shuffle partitions at most) joined to the first of them."""
    first = leaders.groupBy("key").agg(F.min(F.struct("pos", "a", "n")).alias("f"))
    n, f = F.col("n"), F.col("f")
    need = F.ceil(num * (n + f.n) / F.lit(num + den))
    return leaders.join(first, "key").filter((F.col("a") != f.a) & (F.least(n - F.col("pos"), f.n - f.pos) >= need)).select(F.col("f.a").alias("a"), F.col("a").alias("b"))


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, name: Names, whole: bool) -> DataFrame:
    """``members`` (the whole set) or else ``cells`` of the classes in ``wanted`` (``sid``), one row each, from
    one document of each class; stored."""
    column, content = ("members", lambda s: s) if whole else ("cells", cells_of)
    ids = written(wanted.join(classes.filter("rep IS NOT NULL"), "sid").select(F.col("rep").alias("_id")).distinct(), "wanted-ids")

    def run(batches):
        import pyarrow as pa

        def taken(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["sid", column])

        for batch in batches:
            found, size = [], 0
            for text in batch.column(0).to_pylist():
                s = shingles(text, words)
                if len(s):
                    found.append((name(s), content(s).tobytes()))
                    size += len(s)
                if size > 500_000:
                    yield taken(found)
                    found, size = [], 0
            yield taken(found)

    near = F.broadcast(ids) if ids.count() <= 1_000_000 else ids  # rows of 8 bytes; beyond that a shuffled join
    rows = docs.join(near, docs.doc_id == F.col("_id"), "left_semi").select("text").mapInArrow(run, f"sid long, {column} binary")
    found = written(rows, f"class-{column}")
    # rows that repeat an id give their class more than once, or classes not asked for, which join with nothing
    if found.select("sid").groupBy("sid").count().filter("count > 1").limit(1).count():
        found = written(found.groupBy("sid").agg(F.max(column).alias(column)), f"class-{column}")
    return found


def shared_shares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the smaller and of the larger counts of two vectors, row by row; where a count is full, (1, 1):
    nothing is known."""
    low, high = np.minimum(x, y).sum(axis=-1, dtype=np.int64), np.maximum(x, y).sum(axis=-1, dtype=np.int64)
    full = (x == FULL).any(axis=-1) | (y == FULL).any(axis=-1)
    return np.where(full, 1, low), np.where(full, 1, high)


def close_pairs(pairs: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the bound of their count vectors lets pass; only these need their whole sets."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (2, 3))
            low, high = shared_shares(x, y)
            mask = pa.array(den * low >= num * high)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one, two = cells.select(F.col("sid").alias("b"), F.col("cells").alias("y")), cells.select(F.col("sid").alias("a"), F.col("cells").alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one = sets.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    two = sets.select(F.col("sid").alias("a"), F.col("members").alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def lot_of(s: int, t: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each pair, the same for either order."""
    mixed = (np.array([s]).astype(np.uint64) * _A ^ t.astype(np.uint64) * _A) * _B
    return ((mixed ^ (mixed >> np.uint64(31))) * _A >> np.uint64(40)).astype(np.float64) / (1 << 24)


def cross_pairs(one: dict, two: dict, num: int, den: int, lot: tuple[float, float]) -> list[tuple[int, int]]:
    """Pairs (smaller name first) of a row of each table that lie in different components, belong to the
    lot and pass all bounds; regions of few members have but one lot, which is the first."""
    out = []
    whole = max(len(one["sid"]), len(two["sid"])) <= WHOLE
    if whole and lot[0] > 0:
        return out
    order = np.argsort(two["n"], kind="stable")
    sid, n, pos, comp, cells = (two[c][order] for c in ("sid", "n", "pos", "comp", "cells"))
    for s, m, p, c, x in zip(one["sid"].tolist(), one["n"].tolist(), one["pos"].tolist(), one["comp"].tolist(), one["cells"], strict=True):
        # partners are at least num / den and at most den / num times as large
        a, b = np.searchsorted(n, -(-num * m // den)), np.searchsorted(n, den * m // num, side="right")
        y = a + np.flatnonzero((comp[a:b] != c) & may_link(m, n[a:b], p, pos[a:b], num, den))
        if not whole:
            h = lot_of(s, sid[y])
            y = y[(h >= lot[0]) & (h < lot[1])]
        for k in range(0, len(y), 4096):
            some = y[k:k + 4096]
            low, high = shared_shares(cells[some], x)
            out += [(min(s, t), max(s, t)) for t in sid[some[den * low >= num * high]].tolist()]
    return out


MEMBER = "sid long, n int, pos int, comp long, cells binary"


def _table(table) -> dict:
    out = {c: table.column(c).to_numpy().astype(np.int64) for c in ("sid", "n", "pos", "comp")}
    out["cells"] = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
    return out


def _pair_table(pa, pairs: list[tuple[int, int]]):
    pairs = sorted(set(pairs))
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def joined_regions(members: DataFrame, num: int, den: int, lot: tuple[float, float]) -> DataFrame:
    """Pairs across components within regions of at most ``JOINED`` members each."""
    def run(table):
        import pyarrow as pa

        rows = _table(table)
        return _pair_table(pa, cross_pairs(rows, rows, num, den, lot))

    return members.select("key", *(x.split()[0] for x in MEMBER.split(", "))).groupBy("key").applyInArrow(run, "a long, b long")


def split_regions(members: DataFrame, num: int, den: int, depth: int, pivots: int = 8) -> DataFrame:
    """Each region's members, one row each, with their Voronoi cells as bits of ``met``.

    A member goes to the nearest of the pivots that its region draws, and by the triangle inequality
    to all within twice the threshold's distance of that.
    """
    draw = Window.partitionBy("key").orderBy(F.xxhash64("sid", F.lit(depth)), "sid")
    drawn = members.select("key", "sid", "cells", F.row_number().over(draw).alias("k")).filter(F.col("k") <= pivots)
    packed = drawn.groupBy("key").agg(F.collect_list("cells").alias("pivots"))
    names = ["key", "size", "sid", "n", "pos", "comp"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cells, met = batch.column(len(names)).to_pylist(), []
            for x, drawn in zip(cells, batch.column(len(names) + 1).to_pylist(), strict=True):
                low, high = shared_shares(np.frombuffer(b"".join(drawn), np.uint8).reshape(-1, CELLS), np.frombuffer(x, np.uint8))
                # a full count tells nothing: the member goes everywhere
                far = np.where((low == 1) & (high == 1), 0.0, 1 - low / np.maximum(high, 1))
                met.append(sum(1 << k for k in np.flatnonzero(far <= far.min() + 2 * (1 - num / den) + 1e-9).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(met, pa.int32())], [*names, "met"])

    met = spread(members.select(*names, "cells"), packed, ["key"], "sid").select(*names, "cells", "pivots")
    return met.mapInArrow(run, "key long, size long, sid long, n int, pos int, comp long, met int")


def unsplit_keys(split: DataFrame, pivots: int = 8) -> DataFrame:
    """Regions whose cells would hold half of the region's pairs or more."""
    counts = [F.sum(F.shiftright("met", k).bitwiseAND(F.lit(1))).cast("double") for k in range(pivots)]
    inside = reduce(lambda x, y: x + y, (c * c for c in counts))
    return split.groupBy("key").agg(inside.alias("inside"), F.first("size").cast("double").alias("all")).filter(2 * F.col("inside") >= F.col("all") * F.col("all")).select("key")


def cells_apart(split: DataFrame, pivots: int = 8) -> DataFrame:
    """A row for each member in each of its Voronoi cells, which are regions now."""
    of = F.filter(F.sequence(F.lit(0), F.lit(pivots - 1)), lambda k: F.expr("met").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    return split.withColumn("_cell", F.explode(of)).select(F.xxhash64("key", "_cell").alias("key"), "sid", "n", "pos", "comp")


def block_pairs(members: DataFrame, num: int, den: int, lot: tuple[float, float]) -> DataFrame:
    """Pairs across components in regions that do not shrink, by blocks of bounded size.

    Members of a region's largest component meet all others but not each other, so work grows with
    the rest of the region; no task gets more than a block of each side.
    """
    each = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = each.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("inner"), F.sum("c").alias("all"))
    sizes = sizes.select("key", "main", F.ceil((F.col("all") - F.col("inner")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("inner") / RUN).cast("int").alias("runs"))
    rows = spread(members, sizes, ["key"], "sid")
    inner, mixed = F.col("comp") == F.col("main"), F.xxhash64("sid")
    own = F.when(inner, F.pmod(mixed, F.col("runs"))).otherwise(F.pmod(mixed, F.col("blocks"))).cast("int")
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    blocks, runs = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("runs") - 1)
    rows = rows.withColumn("_own", own)
    places = F.when(inner, F.transform(blocks, lambda b: place(0, b, F.col("_own")))).otherwise(
        F.concat(F.transform(runs, lambda r: place(0, F.col("_own"), r)), F.transform(blocks, lambda b: place(1, F.least(b, F.col("_own")), F.greatest(b, F.col("_own"))))))
    dealt = rows.withColumn("at", F.explode(places)).select("key", "at.*", inner.alias("inner"), *(x.split()[0] for x in MEMBER.split(", ")))

    def run(table):
        import pyarrow as pa

        rows = _table(table)
        side = table.column("inner").to_numpy()
        part = lambda mask: {c: x[mask] for c, x in rows.items()}
        pairs = cross_pairs(part(~side), part(side), num, den, lot) if side.any() else cross_pairs(rows, rows, num, den, lot)
        return _pair_table(pa, pairs)

    return dealt.groupBy("key", "kind", "i", "j").applyInArrow(run, "a long, b long")


def region_pairs(members: DataFrame, cells: DataFrame, num: int, den: int, lot: tuple[float, float] = (0.0, 1.0), joined: int = JOINED) -> list[DataFrame]:
    """Pairs of a lot across components in regions that links have not made one component, by rounds.

    ``members``: ``key``, ``sid``, ``n``, ``pos``, ``comp`` and the ``size`` of the region, stored; ``cells`` by ``sid``.  A
    round splits the regions of more than ``joined`` members: a split leaves less than half of a region's
    pairs, and so twice its members at most, or the region is joined by blocks and no copies are made.
    """
    out, rows, depth = [], members, 0
    held = lambda df: df.join(cells, "sid")
    while True:
        out.append(written(joined_regions(held(rows.filter(F.col("size") <= joined)), num, den, lot), "region-pairs"))
        large = rows.filter(F.col("size") > joined)
        if large.limit(1).count() == 0:
            return out
        split = written(split_regions(held(large), num, den, depth), "voronoi")
        stuck = written(unsplit_keys(split), "stuck-regions")
        out.append(written(block_pairs(held(spread(large, stuck, ["key"], "sid").drop("size")), num, den, lot), "block-pairs"))
        left = matched(split, stuck, ["key"], "sid", "left_anti")
        rows = written(open_regions(written(cells_apart(left), "cells-apart")), "open-regions")
        depth += 1


def open_regions(members: DataFrame) -> DataFrame:
    """Members of regions of more than one component, with the region's ``size``."""
    state = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return matched(members, written(state.filter("lo <> hi").select("key", "size"), "open-keys"), ["key"], "sid")


def with_partners(members: DataFrame, num: int, den: int, small: int = SMALL) -> DataFrame:
    """``members`` (``key``, ``sid``, ``n``, ``pos``; stored) without those of regions of more than ``small`` that sizes
    and positions bar from all others of their region.

    By :func:`may_link`, a set of ``n`` that meets its region at ``pos`` links with at most ``reach`` n-grams; so a
    partner is no larger than the set's reach, and reaches the set.  Of all sets of about a size, the two
    of largest reach tell whether one is such a partner.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > small)
    sizes = written(sizes, "large-keys")
    reach = F.expr(f"cast(n - pos as bigint) * {num + den} div {num} - n")
    large = matched(members, sizes, ["key"], "sid").withColumn("reach", reach).withColumn("band", F.floor(F.log2("n") * 32))
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("reach"), "sid"))
    best = large.withColumn("rank", rank).filter(F.col("rank") <= 2)
    low = F.pow(F.lit(2.0), F.col("band") / 32) * (1 - 1e-9)  # no set of the band is smaller
    tops = best.groupBy("key", "size").agg(F.collect_list(F.struct("sid", "reach", low.alias("low"))).alias("tops"))
    # about a JOINED of rows to each copy of what is known of their region, which is bounded
    runs = F.floor(F.col("size") / JOINED)
    copies = tops.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), runs))).drop("size")
    dealt = large.withColumn("_run", F.pmod(F.xxhash64("sid"), runs + 1))
    met = F.exists("tops", lambda y: (y.sid != F.col("sid")) & (y.low <= F.col("reach")) & (y.reach >= F.col("n")))
    kept = dealt.join(copies, ["key", "_run"]).filter(met).select("key", "sid", "n", "pos")
    return matched(members, sizes.select("key"), ["key"], "sid", "left_anti").select("key", "sid", "n", "pos").unionByName(kept)


def outer_regions(members: DataFrame) -> DataFrame:
    """``members`` (with their region's ``size``) without the regions that lie inside an earlier one.

    N-grams of a passage have the same texts in their regions, or fewer from n-gram to n-gram.  Where all members
    of a region have the same region as the largest before it, all its pairs meet there at earlier
    positions, so under weaker bounds.  Positions fall along such chains, so each ends in a region that stays.
    """
    before = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = members.select("key", F.max(F.struct("size", "pos", "key")).over(before)["key"].alias("outer"))
    of = seen.groupBy("key").agg(F.min("outer").alias("lo"), F.max("outer").alias("hi"), F.count("outer").alias("with"), F.count(F.lit(1)).alias("all"))
    inner = written(of.filter("`with` = `all` AND lo = hi").select("key"), "inner-regions")
    return matched(members, inner, ["key"], "sid", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the smallest id of its component) of the ends of ``edges`` (a, b: ids).

    Labels travel along edges and then jump to their label's label until none changes; each round
    is a stored table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # a vertex of many edges, or the label of a giant component, is one key: few labels are broadcast, else its rows are dealt over runs
        near = matched(both, labels.select(F.col("id").alias("b"), "label"), ["b"], "a").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        target = stepped.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = written(matched(stepped, target, ["label"], "id").select("id", "was", F.col("next").alias("label")), "labels")
        labels = jumped.select("id", "label")
        if jumped.filter("label <> was").limit(1).count() == 0:
            return labels


def similar_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, bits: int = 64, joined: int = JOINED, hot: int | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Documents link when ``den * |intersection| >= num * |union|``; the component is named by the
    smallest doc_id in it.  Null text is empty; empty sets link with nothing and are components of
    their own.  Rows that repeat a doc_id are one vertex of the link graph.  Null doc_ids come
    after all others and link with nothing but equal sets.  Other columns are ignored; an empty
    table gives no rows.  ``bits`` are those of a class's first name, regions of at most ``joined`` members
    are joined as they are, and those of n-grams that more than ``hot`` documents hold (by default a
    share of all that depends on the partitions) are dealt over runs.
    """
    rows, classes, links, _ = linked(docs, words, num, den, bits, joined, hot)
    reps = classes.filter("rep IS NOT NULL")
    ends = (links.join(reps.select(F.col("sid").alias("a"), F.col("rep").alias("ra")), "a")
            .join(reps.select(F.col("sid").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    # an id whose rows have different sets links their classes
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    several = written(some.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("doc_id"), "repeated-ids")
    if several.limit(1).count():
        of = some.join(several, "doc_id").select("doc_id", "sid").distinct().join(reps, "sid").select("doc_id", "rep")
        ends = ends.unionByName(of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b"))
    by_rep = components(ends)
    by_class = classes.join(by_rep, classes.rep == by_rep.id, "left").select("sid", F.coalesce("label", "rep").alias("component"))
    return to_rows(rows, by_class).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def linked(docs: DataFrame, words: int, num: int, den: int, bits: int = 64, joined: int = JOINED, hot: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, Names]:
    """Rows (``doc_id``, ``n``, ``sid``), classes (``sid``, ``rep``: the smallest id), links of classes
    (``a``, ``b``) that make their components, and the naming of classes."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned, levels = scan(base, words, bits)
    rows, name = named_rows(scanned, bits)
    classes = written(rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep")), "classes")
    hot = hot or max(1024, rows.count() // (4 * shares_of(docs.sparkSession)))
    met = written(first_pairs(regions(base, words, num, den, levels, name, hot), num, den), "regions")
    pairs = met.filter("kind = 0").select("a", "b").unionByName(leader_pairs(met.filter("kind = 2").drop("b"), num, den)).distinct()
    members = met.filter("kind = 1").select("key", F.col("a").alias("sid"), "n", "pos").distinct()
    pairs, members = written(pairs, "pairs"), written(members, "members")
    members = written(with_partners(members, num, den), "members")
    ends = lambda p: written(p.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "ends")
    wanted = written(ends(pairs).unionByName(members.select("sid")).distinct(), "wanted")
    cells = sets_of(base, classes, wanted, words, name, whole=False)
    whole = lambda near, tag: written(verified(near, sets_of(base, classes, ends(near), words, name, whole=True), num, den), tag)
    links = whole(written(close_pairs(pairs, cells, num, den), "close-pairs"), "links")
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for lot in LOTS:
        labels = components(links).select(F.col("id").alias("sid"), F.col("label").alias("found"))
        placed = members.join(labels, "sid", "left").select("key", "sid", "n", "pos", F.coalesce("found", "sid").alias("comp"))
        rows_of = written(open_regions(written(placed, "placed")).filter(F.col("size") > (WHOLE if lot[0] else 0)), "open-regions")
        if not lot[0]:  # the same regions stand for those inside them in all lots
            rows_of = written(outer_regions(rows_of), "outer-regions")
            members = rows_of.select("key", "sid", "n", "pos")
        if rows_of.limit(1).count() == 0:
            break
        more = reduce(DataFrame.unionByName, region_pairs(rows_of, cells, num, den, lot, joined)).distinct()
        more = written(more.join(tested, ["a", "b"], "left_anti"), "more-pairs")
        links = links.unionByName(whole(more, "more-links"))
    return rows, classes, links, name


def to_rows(rows: DataFrame, by_class: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of their class (null: no shingles).

    Rows of a class come in shares of bounded size.
    """
    keyed = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(shares_of(rows.sparkSession))))
    shares = keyed.filter("n > 0").select("sid", "run").distinct().join(by_class, "sid").select(F.col("sid").alias("_s"), F.col("run").alias("_r"), "component")
    return keyed.join(shares, (F.col("sid") == F.col("_s")) & (F.col("run") == F.col("_r")) & (F.col("n") > 0), "left").select("doc_id", "n", "sid", "component")


def distinct_documents(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, unchanged.

    Components are of shingle sets here: rows that repeat a doc_id, or have none, stay or go by their
    own text.  Null ids link with nothing but equal sets.  Only rows of ids of which some rows stay
    and some go are shingled again.
    """
    rows, classes, links, name = linked(docs, words, num, den)
    named = classes.filter("rep IS NOT NULL").select("sid")
    ends = links.join(named.select(F.col("sid").alias("a")), "a", "left_semi").join(named.select(F.col("sid").alias("b")), "b", "left_semi")
    labels = components(ends.select("a", "b"))
    placed = classes.join(labels, classes.sid == labels.id, "left").select("sid", "rep", F.coalesce("label", "sid").alias("label"))
    least = placed.groupBy("label").agg(F.min("rep").alias("component"))
    fate = to_rows(rows, placed.join(least, "label").select("sid", "component"))
    goes = F.coalesce(F.col("component").isNotNull() & ~F.col("component").eqNullSafe(F.col("doc_id")), F.lit(False))
    fate = written(fate.select("doc_id", "sid", goes.alias("goes")).distinct(), "fate")
    ids = written(fate.groupBy("doc_id").agg(F.min("goes").alias("all"), F.max("goes").alias("any")).filter("any"), "ids")
    stay = without(docs, ids.select("doc_id"), ["doc_id"])
    mixed = ids.filter(~F.col("all")).select(F.col("doc_id").alias("_fw_id"))
    if mixed.limit(1).count() == 0:
        return stay

    @F.pandas_udf("long")
    def set_of(texts):
        import pandas as pd

        return pd.Series([name(shingles(t, words)) for t in texts], dtype="int64")

    some = docs.join(mixed, docs.doc_id.eqNullSafe(F.col("_fw_id")), "left_semi").withColumn("_fw_sid", set_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    gone = fate.filter("goes").select("doc_id", F.col("sid").alias("_fw_sid"))
    return stay.unionByName(without(some, gone, ["doc_id", "_fw_sid"]).drop("_fw_sid"))
