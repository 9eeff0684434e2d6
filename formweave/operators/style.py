"""House style: how each type of annotation is drawn, by mode and agreement, with a corpus-wide row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLES, LOW_AGREEMENT, ANY = 3, 0.7, "*"


def _mode(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Most frequent value per scope with its share; nulls and "" have no say; ties: first seen.

    Values are counted per type and value before anything else, so a scope of any size costs a row
    per distinct value; the row ``*`` sums those counts.
    """
    counts = rows.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy("annot_type", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    total = counts.groupBy("v").agg(F.sum("n").alias("n"), F.min("ord").alias("ord")).select(F.lit(ANY).alias("scope"), "v", "n", "ord")
    every = counts.select(F.col("annot_type").alias("scope"), "v", "n", "ord").unionByName(total)
    first = Window.partitionBy("scope").orderBy(F.desc("n"), "ord")
    share = F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("scope")), 3)
    return every.withColumn(f"{prefix}_agreement", share).withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("scope", F.col("v").alias(column), f"{prefix}_agreement")


def house_style(annotations: DataFrame, placements: DataFrame) -> DataFrame:
    """One row per annotation type and one for ``*``.

    ``annotations``: ``annot_type``, ``text_color`` (any type that compares), ``font_name``,
    ``font_size``, ``ord``.  ``placements``: ``annot_type``, ``relative_label``, ``offset_x_pct``,
    ``offset_y_pct``, ``ord`` of accepted links.
    """
    scope = F.when(F.grouping("annot_type") == 1, F.lit(ANY)).otherwise(F.col("annot_type")).alias("scope")
    out = annotations.rollup("annot_type").agg(F.grouping("annot_type").alias("_g"), F.count(F.lit(1)).alias("samples")).select(F.when(F.col("_g") == 1, ANY).otherwise(F.col("annot_type")).alias("scope"), "samples")
    medians = placements.rollup("annot_type").agg(scope, F.count(F.lit(1)).alias("placement_samples"), F.bround(F.median("offset_x_pct"), 4).alias("offset_x_pct"), F.bround(F.median("offset_y_pct"), 4).alias("offset_y_pct")).drop("annot_type")
    for part in (_mode(annotations, "text_color", "color"), _mode(annotations, "font_name", "font"), _mode(annotations, "font_size", "size"), _mode(placements, "relative_label", "placement"), medians):
        out = out.join(part, "scope", "left")  # a row per type
    zero = {c: 0.0 for c in ("color_agreement", "font_agreement", "size_agreement", "placement_agreement", "offset_x_pct", "offset_y_pct", "font_size")}
    out = out.fillna(zero).fillna({"placement_samples": 0, "font_name": "", "relative_label": ""}).withColumnRenamed("relative_label", "placement")
    return out.withColumn("settled", settled())


def style_of_corpus(annotations: DataFrame, links: DataFrame) -> DataFrame:
    """House style of stored studies: every annotation, and the placement of accepted links."""
    marks = annotations.withColumn("ord", F.struct("doc_id", "page", "ord"))
    kinds = annotations.select("doc_id", "annotation_id", "annot_type")
    placed = links.filter(~F.col("rejected") & F.col("relative_label").isNotNull()).join(kinds, ["doc_id", "annotation_id"])
    return house_style(marks, placed.withColumn("ord", F.struct("doc_id", "page", "annotation_id")))


def settled():
    """Whether a rule has enough samples that agree."""
    return (F.col("samples") >= MIN_SAMPLES) & (F.least("color_agreement", "font_agreement", "size_agreement") >= LOW_AGREEMENT)


def unsettled(style: DataFrame) -> DataFrame:
    """Rules that a person should decide."""
    return style.filter(~F.col("settled"))


def rule_for(wanted: DataFrame, style: DataFrame, column: str = "annot_type") -> DataFrame:
    """``wanted`` with the rule of its type: the type's own if it has enough samples, else the default."""
    names = [c for c in style.columns if c != "scope"]
    own = style.filter(F.col("scope") != ANY).select(F.col("scope").alias(column), F.struct(*names).alias("_own"))
    base = style.filter(F.col("scope") == ANY).select(F.struct(*names).alias("_base"))
    # one row per type, and one at most; the planner broadcasts them by their size
    both = wanted.join(own, column, "left").join(base, F.lit(True), "left")
    use_own = (F.col("_own.samples") >= MIN_SAMPLES) | (F.coalesce(F.col("_base.samples"), F.lit(0)) == 0)
    return both.withColumn("rule", F.when(F.coalesce(use_own & F.col("_own").isNotNull(), F.lit(False)), F.col("_own")).otherwise(F.col("_base"))).drop("_own", "_base")
