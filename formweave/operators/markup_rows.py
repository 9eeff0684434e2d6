"""Annotations as rows: ids, statements, types and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M

PAGE = ["doc_id", "page"]
_PARSED = ["variable", "domain", "value", "qnam", "label", "target_page", "variables"]


def statement_rows(annotations: DataFrame) -> DataFrame:
    """One row per statement of every annotation, classified.

    The first annotation of a page, in stored order, is what can tell a domain header from a coded
    value.
    """
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")) == 1
    rows = annotations.select(*PAGE, "ord", "text", first.alias("first"))
    parts = rows.select("*", F.posexplode(M.statements(F.col("text"))).alias("part", "part_text"))
    return parts.select(*PAGE, "ord", "part", "part_text", M.classify(F.col("part_text"), F.col("first")).alias("s")).select(*PAGE, "ord", "part", "part_text", "s.*")


def extract_annotations(annotations: DataFrame, page_forms: DataFrame | None = None) -> DataFrame:
    """``annotation_id``, type and parsed parts of every annotation: those of its surest statement."""
    index = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")) - 1
    rows = annotations.withColumn("annotation_id", F.format_string("p%da%d", F.col("page").cast("long"), index.cast("long")))
    parts = statement_rows(annotations)
    whole = F.struct("part_text", "annot_type", "confidence", *_PARSED, "evidence")
    best = parts.groupBy(*PAGE, "ord").agg(F.max_by(whole, F.struct("confidence", -F.col("part"))).alias("best"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("part", whole.alias("s")))).alias("parts"))
    out = rows.join(best, [*PAGE, "ord"], "left")
    more = F.when(F.col("n") > 1, F.array(F.concat(F.col("n").cast("string"), F.lit(" statements together"))))
    evidence = F.when(F.col("n").isNull(), F.array(F.lit("no text"))).otherwise(F.concat("best.evidence", F.coalesce(more, F.array().cast("array<string>"))))
    out = out.select("*", F.coalesce("best.annot_type", F.lit("NOTE")).alias("annot_type"), F.coalesce("best.confidence", F.lit(0.0)).alias("type_confidence"), *(F.col(f"best.{c}").alias(c) for c in _PARSED), evidence.alias("type_evidence"),
                     F.coalesce("n", F.lit(0)).cast("int").alias("statements"), F.to_json("best").alias("parsed"), F.transform("parts", lambda p: p.s).alias("statement_list")).drop("best", "n", "parts")
    if page_forms is None:
        return out
    return out.join(page_forms.select(*PAGE, "form_name"), PAGE, "left")


def summary(annotations: DataFrame) -> DataFrame:
    """Annotations per type with their statements and ambiguous texts."""
    return annotations.groupBy("annot_type").agg(F.count(F.lit(1)).alias("annotations"), F.sum("statements").alias("statements"), F.count_if(F.col("type_confidence") <= M.AMBIGUOUS).alias("ambiguous")).orderBy("annot_type")
