"""Exact dedup by a tree-merge of sorted digest runs; DataFrame functions only.

Every row gets the SHA-256 of its normalised text.  The rows form ``runs`` sorted digest runs.  In
each round a run sends its entries to the partner whose number it shares after dropping the low
bits (a binomial tree of radix ``2 ** bits``); the receiver merges the sorted runs and keeps for
each digest the best entry: longest original, then smallest id.  Candidates of one digest are
verified at every level by a second digest and the normalised length, which are part of the key.
The best entries then go back down the same tree, so a digest that a third of all rows share is
spread over all runs at the leaves and no task or join key ever receives more than a run's share.
Texts never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shares_of, without, written

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

_KEY = ("digest", "check", "norm_len")


def normalised(text: Column) -> Column:
    """``text`` (null: empty) without the six ASCII blanks."""
    out = F.coalesce(text, F.lit(""))
    for ch in BLANKS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One entry per row: id, digest, verification values and length of the original."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
                       normalised(F.col(text_col)).alias("norm"))
    return base.select("doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("digest"),
                       F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("norm_len"))


def tree_merge(entries: DataFrame, runs: int | None = None, bits: int = 2) -> DataFrame:
    """Entries with ``keep_id`` and ``group_size`` of their digest added.

    ``entries`` must be stored (it is read twice).  A null id ranks after every other.  There are as
    many runs as shuffle partitions, 64 at least, if not given.
    """
    runs = runs or shares_of(entries.sparkSession, 64)
    best = F.min("best").alias("best"), F.sum("n").alias("n")
    leaf = entries.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
    start = F.struct((-F.col("chars")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    levels = [leaf.groupBy(*_KEY, "run").agg(F.min(start).alias("best"), F.count(F.lit(1)).alias("n"))]
    width = runs
    while width > 1:
        width = -(-width // (1 << bits))
        up = levels[-1].withColumn("run", F.shiftright("run", bits))
        levels.append(up.groupBy(*_KEY, "run").agg(*best))
    down = levels[-1]
    for below in reversed(levels[:-1]):
        above = down.select(*_KEY, F.col("run").alias("up"), F.col("best").alias("b"), F.col("n").alias("c"))
        down = (below.withColumn("up", F.shiftright("run", bits)).join(above, [*_KEY, "up"])
                .select(*_KEY, "run", F.col("b").alias("best"), F.col("c").alias("n")))
    return (leaf.join(down, [*_KEY, "run"])
            .select("doc_id", "chars", "digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best.rank").alias("best_rank")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and empty texts are one group.  Ties in length go to the smaller id.
    Rows that repeat an id are rows of their own; if the id stays, all rows with that id, that text
    and that length are marked kept (:func:`kept_documents` keeps one of them).  Null
    ids lose ties.  Other columns are ignored; an empty table gives an empty result.
    """
    entries = written(digests(docs, id_col, text_col), "digests")
    merged = tree_merge(entries, runs, bits)
    return merged.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (-F.col("chars") == F.col("best_rank"))).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged; of identical rows one stays.

    Only the keys of rows that go, or that repeat, move; they are broadcast if few.
    """
    fate = written(exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "fate")
    key = ["doc_id", "_fw_sha"]
    keyed = docs.withColumn("_fw_sha", F.sha2(normalised(F.col("text")), 256))
    gone = fate.filter(~F.col("stays")).withColumnRenamed("text_sha256", "_fw_sha")
    repeated = written(fate.filter("stays AND n > 1").select("doc_id", F.col("text_sha256").alias("_fw_sha")), "repeated")
    if repeated.limit(1).count() == 0:
        return without(keyed, gone, key).drop("_fw_sha")
    once = without(keyed, gone.select(*key).unionByName(repeated), key)
    order = Window.partitionBy(*key).orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))))
    again = (keyed.join(repeated.select(F.col("doc_id").alias("_fw_id"), F.col("_fw_sha").alias("_fw_key")), keyed.doc_id.eqNullSafe(F.col("_fw_id")) & (keyed._fw_sha == F.col("_fw_key")), "left_semi")
             .withColumn("_fw_k", F.row_number().over(order)).filter("_fw_k = 1").drop("_fw_k"))
    return once.unionByName(again).drop("_fw_sha")
