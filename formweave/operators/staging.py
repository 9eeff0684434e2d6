"""The worksheet of a blank form: pre-filled rows, their geometry, and sheets as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.markup import to_hex
from ..functions.text import normalize
from .style import rule_for

# Statuses, and the worksheet's columns in order.
STATUSES = ["AUTO", "NEEDS_REVIEW", "NEEDS_MAPPING", "APPROVED", "REJECTED"]
COLUMNS = ["row_id", "form_name", "page", "field_text", "item_number", "options", "control", "suggested_variable", "suggested_annotation", "suggested_annot_type", "match_tier", "match_score", "match_source", "match_reason", "known_aliases",
           "final_variable", "final_annotation", "final_annot_type", "status", "reviewer_note", "color_rgb", "font_name", "font_size", "placement"]
EDITABLE = ["form_name", "final_variable", "final_annotation", "final_annot_type", "status", "reviewer_note", "color_rgb", "font_name", "font_size", "placement"]
GEOMETRY = ["row_id", "page", "page_width", "page_height", "rel_x_pct", "rel_y_pct", "rel_w_pct", "rel_h_pct", "offset_x_pct", "offset_y_pct", "group_id", "field_confidence"]


def build_staging(fields: DataFrame, filled: DataFrame, style: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per field: the worksheet's columns and ``geometry``.

    ``filled``: the result of :func:`prefill.prefill`.  Only an AUTO row has its decision filled in.
    """
    best = filled.select("doc_id", "field_id", "best", "status", "aliases")
    rows = fields.join(best, ["doc_id", "field_id"], "left").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    rows = rows.withColumn("_type", F.coalesce(F.nullif("best.annot_type", F.lit("")), F.lit("VARIABLE")))
    rows = rule_for(rows, style, "_type")
    auto = lambda c: F.when(F.col("status") == "AUTO", F.col(c)).otherwise("")
    rel = G.relative(F.col("bbox"), F.col("width"), F.col("height"))
    color = F.col("rule.text_color")
    return rows.select(
        "doc_id", F.col("field_id").alias("row_id"), "form_name", "page", F.col("text").alias("field_text"), "item_number", F.array_join(F.transform("options", lambda o: o.text), " | ").alias("options"), F.array_join("control_kinds", ",").alias("control"),
        F.col("best.variable").alias("suggested_variable"), F.col("best.annotation_text").alias("suggested_annotation"), F.col("best.annot_type").alias("suggested_annot_type"), F.col("best.tier").alias("match_tier"), F.bround("best.confidence", 3).alias("match_score"),
        F.col("best.source").alias("match_source"), F.array_join("best.evidence", "; ").alias("match_reason"), F.array_join("aliases", ", ").alias("known_aliases"),
        auto("best.variable").alias("final_variable"), auto("best.annotation_text").alias("final_annotation"), auto("best.annot_type").alias("final_annot_type"), F.coalesce("status", F.lit("NEEDS_MAPPING")).alias("status"), F.lit("").alias("reviewer_note"),
        F.coalesce(to_hex(color), F.lit("")).alias("color_rgb"), F.coalesce("rule.font_name", F.lit("")).alias("font_name"), F.col("rule.font_size").cast("string").alias("font_size"), F.coalesce("rule.placement", F.lit("")).alias("placement"),
        F.struct(F.col("width").alias("page_width"), F.col("height").alias("page_height"), rel.rel_x_pct.alias("rel_x_pct"), rel.rel_y_pct.alias("rel_y_pct"), rel.rel_w_pct.alias("rel_w_pct"), rel.rel_h_pct.alias("rel_h_pct"),
                 F.coalesce("rule.offset_x_pct", F.lit(0.0)).alias("offset_x_pct"), F.coalesce("rule.offset_y_pct", F.lit(0.0)).alias("offset_y_pct"), F.col("group_id"), F.col("confidence").alias("field_confidence")).alias("geometry"))


def sheets(staging: DataFrame, style: DataFrame, forms: DataFrame, learned: DataFrame) -> dict[str, DataFrame]:
    """The workbook's data sheets.  ``learned``: ``form_key`` and ``domain`` from history."""
    domains = learned.select(F.col("form_key").alias("normalized_name"), F.col("domain").alias("_learned"))
    named = forms.join(domains, "normalized_name", "left")
    own = F.nullif(F.col("domain"), F.lit(""))
    return {
        "Annotations": staging.select("doc_id", *COLUMNS),
        "Geometry": staging.select("doc_id", "row_id", "page", "geometry.*").select("doc_id", *GEOMETRY),
        "HouseStyle": style.select("scope", "samples", to_hex(F.col("text_color")).alias("color_rgb"), "color_agreement", "font_name", "font_size", "size_agreement", "placement", "placement_agreement", "offset_x_pct", "offset_y_pct", "settled"),
        "Forms": named.select("doc_id", F.col("name").alias("form_name"), F.coalesce(own, "_learned", F.lit("")).alias("domain"), F.when(own.isNotNull(), "document").when(F.col("_learned").isNotNull(), "history").otherwise("").alias("domain_source"),
                              F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ").alias("pages"), "confidence", "source"),
    }


def summary(staging: DataFrame) -> DataFrame:
    """Rows per status."""
    return staging.groupBy("status").agg(F.count(F.lit(1)).alias("rows")).orderBy("status")
