"""Best-fit packing of documents into sequences, bulk-synchronously.

Lengths are whole numbers up to the capacity, so documents and gaps in sorted order fall into at
most ``capacity`` classes of equals, and that table of class sizes is all that supersteps exchange:
its size does not depend on the data.  Superstep ``l`` places all documents of length ``l``, from
the longest down: the sweep goes to the successor classes of gaps (the smallest that fit first),
a gap takes as many documents as fit before the next one (ranks in runs resolve every conflict),
what stays opens new sequences, and the used gaps move to their new class.  A superstep's result is a few ranges
``(length, first rank) -> (first sequence, offset)``; executors number the documents of each length
(range-partitioned ranks: a local count plus the counts of earlier partitions) and look their place
up.  The result is that of best-fit decreasing on the whole table.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hub import encoded, read_vocabulary
from .store import bounded_batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def supersteps(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Ranges ``(length, first_rank, first_sequence, offset)`` that place all items.

    ``sizes`` maps lengths (1 to ``capacity``) to counts.  A range ends where the next of its
    length begins.  The number of ranges is bounded by the capacity, not by the counts: each
    superstep opens one run of sequences at most and splits one at most.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    classes: list[int] = []
    opened, out = 0, []
    for length in sorted(sizes, reverse=True):
        rank, left, moved = 0, sizes[length], {}
        at = bisect.bisect_left(classes, length)
        while left and at < len(classes):
            gap = classes[at]
            runs = gaps[gap]
            first, count = runs.pop()
            # best fit returns to a used gap while the length fits: whole gaps first, the last takes the rest
            per = gap // length
            full = min(count, left // per)
            rest = left % per if full < count else 0
            for n, items in ((full, per), (1 if rest else 0, rest)):
                if n:
                    for j in range(items):
                        out.append((length, rank, first, capacity - gap + j * length))
                        rank += n
                    moved.setdefault(gap - items * length, []).append((first, n))
                    first, count, left = first + n, count - n, left - n * items
            if count:
                runs.append((first, count))
            if not runs:
                del gaps[gap]
                del classes[at]
        while left:
            per = capacity // length
            full, rest = divmod(left, per)
            # the first full sequences take `per` documents each, the last takes the rest
            for k, (n, items) in enumerate(((full, per), (1 if rest else 0, rest))):
                if n:
                    for j in range(items):
                        out.append((length, rank, opened, j * length))
                        rank += n
                    moved.setdefault(capacity - items * length, []).append((opened, n))
                    opened += n
            left = 0
        for gap, runs in moved.items():
            if gap > 0:
                _add(gaps, classes, gap, runs)
    return out


def _add(gaps: dict, classes: list, gap: int, runs: list) -> None:
    if gap <= 0:
        return
    if gap not in gaps:
        bisect.insort(classes, gap)
        gaps[gap] = []
    gaps[gap] += runs


def token_pieces(docs: DataFrame, vocabulary: bytes, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every whole text's ids, with a rank among the task's pieces of that length."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tail = struct.pack("<I", end_id)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), encoded(shared.value, batch.column(1)), strict=True):
                raw += tail
                n = len(raw) // 4
                first = n % capacity or capacity
                begin = k = 0
                for end in range(first, n + 1, capacity):
                    rows.append((key, k, begin, end - begin, zlib.crc32(raw[4 * begin:4 * end]), part, int(seen[end - begin])))
                    seen[end - begin] += 1
                    begin, k = end, k + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for stored pieces with ``length``, ``part`` and ``local_rank``.

    ``local_rank`` numbers the pieces of a length within a part from 0.  Lengths are 1 to
    ``capacity``.
    """
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    sizes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = supersteps(sizes, capacity)
    table = np.array(plan, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    order = Window.partitionBy("length").orderBy("part")
    before = counts.select(F.col("length").alias("_l"), F.col("part").alias("_p"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    ranked = (pieces.join(before, (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p")))
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("before")).alias("rank")))

    def place(batches):
        import pyarrow as pa

        t = shared.value
        bounds = np.searchsorted(t[:, 0], np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.empty(len(length), np.int64)
            for one in np.unique(length):
                own, a, b = length == one, bounds[one], bounds[one + 1]
                row[own] = a + np.searchsorted(t[a:b, 1], rank[own], side="right") - 1
            got = t[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got[:, 2] + rank - got[:, 1]), pa.array(got[:, 3])], [x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and the offset where they lie.

    Null text is empty and gives one piece, the end id.  Only documents of more than ``capacity``
    ids are cut; all their pieces but the first are full.  Rows that repeat a doc_id are packed like
    others; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession, 2500, "8m")
    return pack(written(token_pieces(docs, read_vocabulary(vocabulary_path), capacity, end_id), "pieces"), capacity)
