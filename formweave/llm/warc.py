"""WARC archives: one gzip member per record, written in parallel and read back sequentially.

Every task writes one archive into the shared folder; a manifest row per archive is returned, so a
task that runs again leaves an orphan that nobody reads.  The reader inflates member after member
with an incremental decompressor, frames the block by Content-Length and verifies the block digest
and, where there is one, the payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, fresh_dir, open_fs, shares_of, written

_CHUNK = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _page(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; ``refers_to`` is a 1-tuple for a revisit, else None."""
    revisit = refers_to is not None
    block = _HTTP_REVISIT % len(payload) if revisit else _HTTP % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {date}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~"))
    if revisit:
        head += [f"WARC-Refers-To: <{_name(refers_to[0])}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Inflated gzip members of a stream, one at a time."""
    feed, raw, out = zlib.decompressobj(31), b"", []
    while True:
        if not raw:
            raw = stream.read(_CHUNK)
            if not raw:
                break
        out.append(feed.decompress(raw))
        raw = feed.unused_data if feed.eof else b""
        if feed.eof:
            yield b"".join(out)
            feed, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("archive ends inside a record")


def parse(member: bytes) -> dict:
    """Header fields, type and payload of one record; raises on a wrong length or digest."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record is not framed by its Content-Length")
    if "sha1:" + base32_sha1(block) != fields["warc-block-digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and "sha1:" + base32_sha1(payload) != fields["warc-payload-digest"]:
        raise ValueError("payload digest differs")
    size = int(http.rpartition(b"X-Payload-Length:")[2]) if revisit else len(payload)
    return {"page_id": _page(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
            "payload_bytes": size, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": None if revisit else payload.decode()}


def planned(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Pages and, before them, a row per page and payload with ``owner``: the smallest page_id of
    those with the same payload.  Rows of a page lie in one partition, sorted.

    The smallest ids are found on digests alone, first within shares of a payload's rows (as many as shuffle
    partitions) and then over the shares, and go back the same way; html moves once, dealt by page_id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keys = written(base.select("page_id", F.octet_length("html").alias("size"), F.unhex(F.sha2("html", 256)).alias("digest")).distinct()
                   .withColumn("run", F.pmod(F.xxhash64("page_id"), F.lit(shares_of(pages.sparkSession)))), "page-digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"))).alias("first")
    shares = keys.groupBy("digest", "size", "run").agg(first)
    owners = shares.groupBy("digest", "size").agg(F.min("first").alias("owner"))
    back = shares.select("digest", "size", "run").join(owners, ["digest", "size"])
    shared = (F.col("size") >= F.lit(min_payload)) & ~F.col("owner.no_id")
    plan = (keys.join(back, ["digest", "size", "run"])
            .select("page_id", "digest", F.lit(0).alias("kind"), F.col("owner.id").alias("owner"), shared.alias("shared"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    rows = base.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("boolean").alias("shared"), "url", "html")
    return (plan.unionByName(rows).repartition("page_id", F.when(F.col("page_id").isNull(), F.col("digest")))
            .sortWithinPartitions("page_id", "digest", "kind", "url"))


def write_warc(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write archives of ``pages`` into ``folder`` and return their manifest (stored).

    Null html is an empty payload, null urls give no target URI.  Payloads of at least
    ``min_payload`` bytes are written once: the smallest page_id is a response, the others (and
    further rows that repeat that page_id and payload) revisit it.  Null page_ids are larger than
    any id and share nothing with each other.
    """
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, name, count, size, owner, shared, again = None, None, 0, 0, None, False, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    owner, shared, again = row["owner"], row["shared"], False
                    continue
                if out is None:
                    fs, top = open_fs(folder)
                    fs.create_dir(top, recursive=True)
                    task = TaskContext.get()
                    name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                payload = row["html"].encode()
                revisit = shared and (again or owner != row["page_id"])
                data = record(row["page_id"], row["url"], payload, base32_sha1(payload), (owner,) if revisit else None)
                out.write(data)
                count, size, again = count + 1, size + len(data), True
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

    return written(planned(pages, min_payload).mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of the archives a manifest lists, each archive read sequentially by one task."""
    def read(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return files.mapInArrow(read, RECORDS)


def warc_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    bounded_batches(pages.sparkSession)
    return read_warc(write_warc(pages, fresh_dir(pages.sparkSession, "warc"), min_payload))
