"""Queries over extracted layers made from parts: spans, drawings, annotations and their statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup_rows
from ..sources import extracted
from .adapters import table
from .page_queries import box
from .text_queries import markup_strings


def dominant_spans(spark, sf):
    """Two or three spans a line; the longest gives size, font and weight."""
    k = F.col("p_partkey")
    spans = table(spark, sf, "part").select(F.lit("d").alias("doc_id"), F.expr("p_partkey div 40").alias("page"), F.expr("p_partkey div 5 % 8").alias("block_no"), F.expr("p_partkey % 5 div 3").alias("line_no"), k.alias("span_no"), "p_name", F.col("p_size").cast("double").alias("size"), "p_brand", "p_type")
    spans = spans.select("doc_id", "page", "block_no", "line_no", "span_no", F.when(F.col("span_no") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("text"), "size", F.when(F.col("span_no") % 7 == 0, "Some-BOLD").otherwise(F.col("p_type")).alias("font"), (F.col("span_no") % 32).cast("int").alias("flags"))
    return extracted.dominant_spans(spans).select("page", "block_no", "line_no", "text", "size", "font", "bold")


def _drawings(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    b = box(F.lit(10.0), F.lit(20.0), 10 + n % 12 * 40.0 + 1, 20 + k % 5 * 2.0)
    return table(spark, sf, "part").select(F.lit("d").alias("doc_id"), F.expr("p_partkey div 50").alias("page"), k.alias("ord"), b.alias("bbox"), (k % 2 == 0).alias("curved"))


def drawings(spark, sf):
    """Rules and controls among drawings."""
    rows = _drawings(spark, sf)
    pages = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    rules, controls = extracted.split_drawings(rows, pages)
    return rules.select("page", "ord", F.col("orientation").alias("kind"), "span_pct").unionByName(controls.select("page", "ord", "kind", F.lit(None).cast("double").alias("span_pct")))


def annotation_layer(spark, sf):
    """Typed or drawn text, own or inherited appearance, stroke or fill colour."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<double>")
    raw = table(spark, sf, "part").select((k % 3).cast("string").alias("doc_id"), k.alias("ord"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, None).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  x "))).alias("content"), F.col("p_brand").alias("appearance_text"),
                                          F.when(k % 5 == 0, F.concat(F.lit("0.5 g /Cour "), F.col("p_size").cast("string"), F.lit(" Tf"))).when(k % 5 == 1, "").alias("appearance"), F.when(k % 2 == 0, F.array(k / 7, F.lit(0.1), F.lit(0.2))).otherwise(none).alias("stroke"), F.when(k % 3 == 0, F.array(F.lit(0.12345))).otherwise(none).alias("fill"))
    defaults = spark.createDataFrame([("0", "1 0 0 rg /Helv 9 Tf"), ("1", "")], "doc_id string, form_appearance string")
    return extracted.annotation_layer(raw, defaults).select("ord", "text", "font_name", "font_size", F.get("text_color", F.lit(0)).alias("red"), F.get("color", F.lit(0)).alias("first"), F.coalesce(F.size("color"), F.lit(0)).alias("channels"))


def _marks(spark, sf):
    """Markup strings as annotations of pages, seven a page."""
    return markup_strings(spark, sf).select(F.lit("d").alias("doc_id"), F.expr("id div 7").alias("page"), F.col("id").alias("ord"), "text")


def extract_annotations(spark, sf):
    return markup_rows.extract_annotations(_marks(spark, sf)).select("page", "annotation_id", "text", "annot_type", "type_confidence", "variable", "domain", "statements")


def statement_rows(spark, sf):
    return markup_rows.statement_rows(_marks(spark, sf)).select("ord", "part", "part_text", "annot_type", "confidence")


def annotations_summary(spark, sf):
    return markup_rows.summary(markup_rows.extract_annotations(_marks(spark, sf)))


def queries():
    return {f.__name__: f for f in (dominant_spans, drawings, annotation_layer, extract_annotations, statement_rows, annotations_summary)}
