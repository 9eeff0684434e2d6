"""Token-id files: canonical length-limited Huffman codes, independent blocks, checkpoints.

Code lengths come from the counts of all ids (package-merge, at most ``LIMIT`` bits, or two more than the
number of distinct ids needs).  Documents are
coded where their ids are, dealt by ranges of the document id and written in ascending order, one
file per range.  A file holds its code lengths and a run of blocks; a block decodes on its own and
has a bit offset for every ``STEP`` ids of every document, so a reader starts anywhere and decodes
many places at once by table lookup.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hub import encoded, read_vocabulary
from .store import bounded_batches, drop_dir, fresh_dir, open_fs, written, written_at

LIMIT, STEP, BLOCK_IDS = 16, 128, 1 << 18
_MAGIC = b"FWTOK1\0\0"
_FILE, _BLOCK = struct.Struct("<8sII"), struct.Struct("<IIQQI")
MANIFEST = "part int, path string, docs long, ids long"
DECODED = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with a positive count.

    By default ``LIMIT``, or more where that many symbols need it.
    Package-merge: ``limit`` times, pairs of the cheapest items become packages that are merged
    with the symbols; a symbol's length is the number of chosen items that contain it.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    limit = limit or max(LIMIT, (n - 1).bit_length() + 2)
    if n > 1 << limit:
        raise ValueError("too many symbols for this code length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        half = len(merged) // 2
        packages = merged[: 2 * half].reshape(half, 2).sum(axis=1)
    take, total = 2 * n - 2, np.zeros(n, np.int64)
    for is_symbol in reversed(levels):
        chosen = int(is_symbol[:take].sum())
        total[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = total
    return lengths


class Code:
    """Canonical code of given lengths, with its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        symbols = np.flatnonzero(lengths)
        order = symbols[np.lexsort((symbols, lengths[symbols]))]
        size = self.lengths[order]
        self.limit = limit = int(size.max(initial=1))
        if limit > 25:
            raise ValueError("codes of more than 25 bits")
        step = np.left_shift(1, limit - size)
        left = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = left >> (limit - size)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.bits = np.zeros(1 << limit, np.uint8)
        filled = int(step.sum())
        self.symbol[:filled] = np.repeat(order, step)
        self.bits[:filled] = np.repeat(size, step)

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Bits (from a byte boundary) and checkpoints of each document; ``ends`` are its ends in ``ids``."""
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id without a code")
        run = np.concatenate([[0], np.cumsum(size)])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        n_bytes = (run[ends] - run[begins] + 7) >> 3
        base = np.concatenate([[0], np.cumsum(n_bytes)])
        shift = np.repeat(base[:-1] * 8 - run[begins], ends - begins)
        at = run[:-1] + shift
        word, inside = at >> 5, at & 31
        value = self.codes[ids] << (64 - size - inside)  # of at most 25 + 31 bits below 64
        n_words = int(base[-1] // 4 + 3)
        high = np.bincount(word, (value >> 32) & 0xFFFFFFFF, n_words)
        low = np.bincount(word + 1, value & 0xFFFFFFFF, n_words + 1)
        raw = (high + low[:n_words]).astype(np.uint32).astype(">u4").tobytes()
        bits = [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
        marks = [(at[a:b:STEP] - 8 * o).astype("<u4").tobytes() for a, b, o in zip(begins.tolist(), ends.tolist(), base[:-1].tolist(), strict=True)]
        return bits, marks

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all lanes, one after another: lane k has ``counts[k]`` ids from bit ``starts[k]``."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].astype(np.int64), counts[order]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order].astype(np.int64)
        out, mask = np.zeros(int(counts.sum()), np.uint32), np.uint32((1 << self.limit) - 1)
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
        for k, n in enumerate(live.tolist()):
            here = at[:n]
            look = (window[here >> 3] >> (32 - self.limit - (here & 7)).astype(np.uint32)) & mask
            out[first[:n] + k] = self.symbol[look]
            at[:n] = here + self.bits[look]
        return out


def id_table(docs: DataFrame, vocabulary: bytes, end_id: int | None = 0) -> DataFrame:
    """``doc_id``, ``n`` and the ids of every whole text (unsigned 16 or 32 bits, little-endian)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0)
            ids, held, at = [], 0, 0
            for raw in encoded(shared.value, batch.column(1)):
                ids.append(raw + tail)
                held += len(raw)
                if held > 4_000_000:
                    yield _id_batch(pa, keys.slice(at, len(ids)), *narrowed(ids))
                    at, ids, held = at + len(ids), [], 0
            if ids:
                yield _id_batch(pa, keys.slice(at, len(ids)), *narrowed(ids))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, width int, ids binary")


def narrowed(ids: list[bytes]) -> tuple[list[bytes], int]:
    """32-bit ids of texts as 16 bits each if the largest of all fits, and the width in bytes."""
    wide = [np.frombuffer(x, "<u4") for x in ids]
    if max((int(x.max()) for x in wide if len(x)), default=0) > 0xFFFF:
        return ids, 4
    return [x.astype("<u2").tobytes() for x in wide], 2


def _id_batch(pa, keys, ids, width):
    return pa.RecordBatch.from_arrays([keys, pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "n", "width", "ids"])


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def id_counts(ids: DataFrame) -> DataFrame:
    """Global counts per id; each task sends one row per id at most."""
    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.bincount(_wide(raw, width), minlength=len(total))
                got[: len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(ids: DataFrame, folder: str, ids_at: str | None = None) -> DataFrame:
    """Write an id table (stored) as files in ascending doc_id order; returns their manifest.

    Null doc_ids come first; rows that repeat a doc_id follow each other by their ids.  The coded
    rows are stored before they are dealt, for the ranges come from a pass over their ids;
    the folder ``ids_at`` of the id table is deleted then.
    """
    spark = ids.sparkSession
    rows = id_counts(ids).collect()  # one row per vocabulary id: bounded by the vocabulary
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    shared = spark.sparkContext.broadcast(code_lengths(counts).tobytes())

    def squeeze(batches):
        import pyarrow as pa

        code = Code(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            keys, n, width, raw = (c.to_pylist() for c in batch.columns)
            a = held = 0
            for b in range(len(raw)):
                held += n[b]
                if held < 1 << 20 and b < len(raw) - 1:
                    continue
                flat = np.concatenate([_wide(x, w) for x, w in zip(raw[a:b + 1], width[a:b + 1], strict=True)]).astype(np.int64)
                bits, marks = code.encode(flat, np.cumsum(np.array(n[a:b + 1], np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b + 1], pa.int64()), pa.array(n[a:b + 1], pa.int64()), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "marks", "bits"])
                a, held = b + 1, 0

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, out, held, ids_held, docs, total = TaskContext.get().partitionId(), None, [], 0, 0, 0
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.tok"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, top = open_fs(folder)
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(_head(shared.value))
                held.append(row)
                ids_held, docs, total = ids_held + row[1], docs + 1, total + row[1]
                if ids_held >= BLOCK_IDS:
                    out.write(_block(held))
                    held, ids_held = [], 0
        if out is not None:
            if held:
                out.write(_block(held))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "docs", "ids"])

    coded, coded_at = written_at(ids.mapInArrow(squeeze, "doc_id long, n long, marks binary, bits binary"), "coded", "lz4")
    if ids_at:
        drop_dir(spark, ids_at)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = coded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "bits")
    manifest = written(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    drop_dir(spark, coded_at)
    return manifest


def _head(lengths: bytes) -> bytes:
    table = zlib.compress(lengths)
    return _FILE.pack(_MAGIC, len(lengths), len(table)) + table


def _block(rows: list[tuple]) -> bytes:
    keys = np.array([r[0] or 0 for r in rows], "<i8").tobytes()
    some = np.packbits([r[0] is not None for r in rows]).tobytes()
    n, size = np.array([r[1] for r in rows], "<u4"), np.array([len(r[3]) for r in rows], "<u4")
    body = keys + some + n.tobytes() + size.tobytes() + b"".join(r[2] for r in rows)
    bits = b"".join(r[3] for r in rows)
    return _BLOCK.pack(len(rows), len(body), len(bits), int(n.sum()), zlib.crc32(bits, zlib.crc32(body))) + body + bits


def read_blocks(stream):
    """``doc_ids, counts, ids`` of each block of a file, in order; verifies checksums."""
    def exactly(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("token file ends early")
        return got

    magic, symbols, size = _FILE.unpack(exactly(_FILE.size))
    if magic != _MAGIC:
        raise ValueError("not a token file")
    lengths = np.frombuffer(zlib.decompress(exactly(size)), np.uint8)
    if len(lengths) != symbols:
        raise ValueError("code table is damaged")
    code = Code(lengths)
    while head := stream.read(_BLOCK.size):
        docs, body_size, bit_size, total, crc = _BLOCK.unpack(head)
        body, bits = exactly(body_size), exactly(bit_size)
        if zlib.crc32(bits, zlib.crc32(body)) != crc:
            raise ValueError("block is damaged")
        at = 8 * docs
        keys, some = np.frombuffer(body, "<i8", docs), np.unpackbits(np.frombuffer(body, np.uint8, (docs + 7) // 8, at), count=docs).astype(bool)
        at += (docs + 7) // 8
        n, size = np.frombuffer(body, "<u4", docs, at).astype(np.int64), np.frombuffer(body, "<u4", docs, at + 4 * docs).astype(np.int64)
        lanes = -(-n // STEP)
        marks = np.frombuffer(body, "<u4", int(lanes.sum()), at + 8 * docs).astype(np.int64)
        starts = marks + np.repeat(8 * (np.cumsum(size) - size), lanes)
        order = np.arange(len(marks)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        counts = np.minimum(np.repeat(n, lanes) - order * STEP, STEP)
        ids = code.decode(bits, starts, counts)
        if len(ids) != total:
            raise ValueError("block has a wrong number of ids")
        yield [k if ok else None for k, ok in zip(keys.tolist(), some.tolist(), strict=True)], n, ids


def read_ids(manifest: DataFrame) -> DataFrame:
    """Digest rows of all documents in the files that a manifest lists."""
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_fs(path)
                before = 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for keys, n, ids in read_blocks(stream):
                        ends = np.cumsum(n)
                        raw = ids.astype("<u4").tobytes()
                        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(keys, pa.int64()), pa.array(before + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                                         ["part", "doc_id", "start", "n_tokens", "ids_crc32"])
                        before += int(ends[-1])

    spread = manifest.select("part", "path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "part")
    rows = spread.mapInArrow(read, DECODED)
    # one row per file: the ids of all files before it
    before = manifest.select(F.col("part"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, vocabulary_path: str, end_id: int | None = 0) -> DataFrame:
    """Encode ``docs``, write the id files in the shared folder and read them back.

    Null text is empty and has the end id alone; an empty table gives no files and no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 2500, "8m")
    ids, at = written_at(id_table(docs, read_vocabulary(vocabulary_path), end_id), "ids")
    return read_ids(write_ids(ids, fresh_dir(spark, "token-files"), at))
