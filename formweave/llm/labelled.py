"""Bounded samples of labelled rows, and the fixed folds of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, max_rows: int) -> DataFrame:
    """``text`` and 0/1 ``y`` of at most ``max_rows`` labelled ids, spread evenly by a hash of the id.

    Rows without a label or an id are left out.  The ids are bounded by ``max_rows``, which makes
    them safe to broadcast; documents are read once and nothing of them is shuffled.
    """
    ids = (labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & usable)
           .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
           .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "_id").select("text", "y")
