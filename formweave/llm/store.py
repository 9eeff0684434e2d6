"""Shared storage: where operators cut lineage and keep intermediate tables and files.

Everything here lies under the folder named by ``spark.checkpoint.dir``, which the driver and all
executors reach.  A folder of this machine is used only where that setting is absent and the
master is local, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI or path of the shared folder; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="formweave-")
    return made


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Let Arrow batches hold few rows: texts and sets are wide, and every worker holds some batches.

    Every operator that calls Python sets both, so that none depends on what ran before it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shares_of(spark: SparkSession, least: int = 32) -> int:
    """Shares into which the rows of one key are dealt: as many as shuffle partitions, ``least`` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(left: DataFrame, right: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (one row per ``key``), with the rows of a key of ``left`` dealt over
    runs by the column ``by``; every run gets its copy of the one row of ``right``."""
    runs = shares_of(left.sparkSession)
    dealt = left.withColumn("_fw_run", F.pmod(F.xxhash64(by), F.lit(runs)).cast("int"))
    shares = dealt.select(*key, "_fw_run").distinct().join(right, key)
    return dealt.join(shares, [*key, "_fw_run"], how).drop("_fw_run")


def matched(left: DataFrame, right: DataFrame, key: list[str], by: str, how: str = "inner", limit: int = 1_000_000) -> DataFrame:
    """As :func:`spread`, for a stored ``right`` of a few narrow columns: it is counted, and up to ``limit``
    rows are broadcast, so that the rows of ``left`` stay where they are."""
    if right.count() <= limit:
        return left.join(F.broadcast(right), key, how)
    return spread(left, right, key, by, how)


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from those files,
    so a lost executor costs a re-read and never a recomputation of what led here."""
    return written_at(df, tag, codec)[0]


def written_at(df: DataFrame, tag: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As :func:`written`, with the folder, for tables that are dropped once used."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def without(rows: DataFrame, dropped: DataFrame, columns: list[str], limit: int = 1_000_000) -> DataFrame:
    """``rows`` whose values in ``columns`` (nulls equal) are not among those of ``dropped``.

    ``dropped`` is stored and counted first: up to ``limit`` of its rows are broadcast, so that
    texts stay where they are; more make it a shuffled join.
    """
    named = dropped.select(*(F.col(c).alias(f"_without_{c}") for c in columns)).distinct()
    named = written(named, "dropped")
    if named.count() <= limit:
        named = F.broadcast(named)
    return rows.join(named, reduce(and_, (rows[c].eqNullSafe(F.col(f"_without_{c}")) for c in columns)), "left_anti")


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI (``file``, ``hdfs``, ``s3``, ``gs``) or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
