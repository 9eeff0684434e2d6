"""Queries over texts: labels, titles, references, markup classes, appearance strings, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X
from ..operators import forms as FM
from .adapters import table


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "line"))


def markup_strings(spark, sf):
    """One string of every class per part, from its words and numbers."""
    two = F.upper(F.substring("p_name", 1, 2))
    word = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    kinds = [F.lit("[NOT SUBMITTED]"), F.concat(F.lit("See Page "), F.col("p_size").cast("string")), F.concat(word, F.lit(" when SUPPDM.QNAM="), word), F.concat(F.lit("DM="), F.initcap("p_name")), F.concat(F.lit("DS="), word),
             F.concat(word, F.lit(" = "), F.col("p_type")), F.concat(F.lit("AGE derived from "), word), F.concat(two, F.lit("."), word), word, F.concat(word, F.lit(" / "), two, F.lit("ORRES")), F.col("p_name"), F.concat(F.lit("SUPP"), two, F.lit(" note"))]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int")).alias("text"), (F.col("p_partkey") % 2 == 0).alias("first"))


def normalize_labels(spark, sf):
    return _lines(spark, sf).select("doc_id", "ord", X.normalize(F.col("line")).alias("key"))


def split_label(spark, sf):
    item = F.element_at(F.array(*map(F.lit, ("1. ", "a) ", "(3) ", "iv. ", "• ", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    raw = F.concat(item, "line", F.when(F.col("doc_id") % 2 == 0, ":").otherwise(" ?*"))
    rows = _lines(spark, sf).select("doc_id", "ord", raw.alias("raw"))
    return rows.select("doc_id", "ord", X.item_number(F.col("raw")).alias("item"), X.label(F.col("raw")).alias("label"))


def clean_title(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ("Form: ", "CRF - ", "Module: ", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, ("", " (continued)", " cont'd", " [continued]", " - continued"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.clean_title(F.concat(prefix, F.initcap("p_name"), suffix)).alias("title"))


def see_page_refs(spark, sf):
    text = F.concat("p_name", F.lit(" see page "), F.col("p_size").cast("string"), F.lit(", See pg. "), (F.col("p_partkey") % 9).cast("string"), F.lit(" oversee page 4"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(X.see_pages(text), lambda p: p.cast("string")), ",").alias("pages"))


def classify_markup(spark, sf):
    s = M.classify(F.col("text"), F.col("first"))
    return markup_strings(spark, sf).select("id", "text", s.alias("s")).select("id", "text", "s.annot_type", "s.confidence", "s.variable", "s.domain", "s.value", "s.qnam", "s.label", "s.target_page", F.array_join("s.evidence", "; ").alias("evidence"))


def split_statements(spark, sf):
    return markup_strings(spark, sf).select("id", F.array_join(M.statements(F.col("text")), "|").alias("parts"))


def parse_appearance(spark, sf):
    c = [(F.col("p_partkey") * k % 11 / 10).cast("string") for k in (1, 3, 7, 9)]
    color = F.element_at(F.array(F.concat_ws(" ", c[0], c[1], c[2], F.lit("rg")), F.concat_ws(" ", c[0], F.lit("g")), F.concat_ws(" ", *c, F.lit("k")), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    da = F.concat(color, F.lit(" /Helv "), (F.col("p_size") % 14).cast("string"), F.lit(".5 Tf"))
    p = M.parse_appearance(da)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), p.alias("p")).select("id", "p.font_name", "p.font_size", *(F.element_at("p.text_color", i).alias(f"c{i}") for i in (1, 2, 3)))


def hex_round_trip(spark, sf):
    color = F.array(*((F.col("p_partkey") * k % 101 / 100) for k in (1, 3, 7)))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), M.to_hex(color).alias("hex"))
    return rows.select("id", "hex", *(F.element_at(M.from_hex(F.col("hex")), i).alias(f"c{i}") for i in (1, 2, 3)))


def foreign_domain(spark, sf):
    var = F.concat(F.element_at(F.array(*map(F.lit, ("DS", "MH", "AG", "XX"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("TERM", "E", "STDTC"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), var.alias("variable"), M.foreign_domain(var, F.lit("MH")).alias("foreign_domain"))


def _titles(spark, sf):
    """Conversations as documents: some turns carry a title, the others continue."""
    named = F.when(F.crc32(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")) % 3 == 0, F.concat(F.lit("Form "), (F.col("conv_id") % 7 + F.col("turn") % 2).cast("string"))).otherwise("")
    return (table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), named.alias("form_name"), F.lit("DM").alias("form_domain"))
            .withColumn("form_source", F.when(F.col("form_name") != "", "TITLE_LINE")).withColumn("form_confidence", F.lit(0.95)).withColumn("form_evidence", F.array(F.lit("title"))).withColumn("raw_title", F.nullif("form_name", F.lit(""))))


def form_forward_fill(spark, sf):
    return FM.fill_forward(_titles(spark, sf)).select("doc_id", "page", "form_name", "form_source")


def forms_fold(spark, sf):
    f = FM.collect_forms(FM.fill_forward(_titles(spark, sf)))
    return f.select("doc_id", "normalized_name", "name", "first_page", F.size("pages").alias("pages"), F.size("continuation_pages").alias("continued"))


def queries():
    return {f.__name__: f for f in (normalize_labels, split_label, clean_title, see_page_refs, classify_markup, split_statements, parse_appearance, hex_round_trip, foreign_domain, form_forward_fill, forms_fold)}
