"""Queries over pages made from document lines: anchors, columns, roles, fields, titles and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import fields, forms, layout
from .box_queries import PAGE_H, PAGE_W, _pages, _placed

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0, y0, x1, y1):
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def controls(spark, sf):
    """A control right of every fourth line."""
    b = F.col("bbox")
    return _placed(spark, sf).filter("ord % 4 = 0").select("doc_id", "page", "ord", box(b.x1 + 15, b.y0 + 1, b.x1 + 27, b.y1 - 1).alias("bbox"), F.when(F.col("ord") % 8 == 0, "BOX").otherwise("CIRCLE").alias("kind"))


def bands(spark, sf):
    """Two bands; every third page has one."""
    p = _pages(spark, sf).select("doc_id", "page")
    row = lambda df, i, x0, x1, hint: df.select("doc_id", "page", F.lit(i).alias("index"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(hint).alias("role_hint"))
    two = p.filter("page % 3 <> 0")
    return row(p.filter("page % 3 = 0"), 0, 0.0, PAGE_W, "UNKNOWN").unionByName(row(two, 0, 0.0, 290.0, "QUESTION_ZONE")).unionByName(row(two, 1, 290.0, PAGE_W, "RESPONSE_ZONE"))


def rules(spark, sf):
    """A rule between the fourth and the fifth line of every second page, and upright ones that say nothing."""
    p = _pages(spark, sf)
    rule = lambda df, n, b, kind: df.select("doc_id", "page", F.lit(n).alias("ord"), b.alias("bbox"), F.lit(kind).alias("orientation"), F.lit(0.85).alias("span_pct"))
    lit = lambda *v: box(*map(F.lit, v))
    return rule(p.filter("page % 2 = 0"), 0, lit(50.0, 86.5, 560.0, 87.5), "H").unionByName(rule(p, 1, lit(55.0, 0.0, 56.0, 800.0), "V"))


def groups(spark, sf):
    """Lines as labels: some end with a colon, the first is a header, late ones are footers, some are markup."""
    text = F.when(F.col("ord") % 5 == 2, F.concat("text", F.lit(":"))).otherwise(F.col("text"))
    region = F.when(F.col("ord") == 0, "HEADER").when(F.col("ord") >= 40, "FOOTER").otherwise("BODY")
    return _placed(spark, sf).select("doc_id", "page", F.col("ord").cast("int").alias("group_id"), text.alias("text"), "bbox", "size", "bold", region.alias("region"), "column", (F.col("ord") % 13 == 12).alias("markup_only"))


def roles(spark, sf):
    return layout.assign_roles(groups(spark, sf), controls(spark, sf), bands(spark, sf))


def page_names(spark, sf):
    """The text of the fourth line as the name of its page's form."""
    named = groups(spark, sf).filter("group_id = 3").select("page", F.col("text").alias("form_name"))
    return _pages(spark, sf).select("doc_id", "page").join(named, "page", "left").fillna({"form_name": ""}).select("doc_id", "page", "form_name")


def anchors_argmin(spark, sf):
    return layout.anchors(_placed(spark, sf), controls(spark, sf), bands(spark, sf)).select("page", "ord")


def group_lines(spark, sf):
    rows = _placed(spark, sf)
    g = layout.group_lines(rows, layout.anchors(rows, controls(spark, sf), bands(spark, sf)), rules(spark, sf))
    return g.select("page", "group_id", F.md5("text").alias("text_md5"), "line_count", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"), "column")


def column_of_line(spark, sf):
    return layout.assign_columns(_placed(spark, sf), bands(spark, sf)).select("page", "ord", "column")


def body_lines(spark, sf):
    rows = groups(spark, sf).withColumn("from_annotation", F.col("markup_only"))
    return layout.body_lines(rows).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("group_id").alias("ids"))


def page_text(spark, sf):
    rows = groups(spark, sf).withColumn("from_annotation", F.col("markup_only")).withColumnRenamed("group_id", "ord")
    return layout.page_text(rows).select("page", F.md5("text").alias("text_md5"))


def groups_of_role(spark, sf):
    return layout.groups_of_role(roles(spark, sf), "QUESTION").select("page", "group_id")


def role_scoring(spark, sf):
    return roles(spark, sf).select("page", "group_id", "role", "role_confidence", F.size("role_evidence").alias("reasons"))


def field_candidates(spark, sf):
    return fields.candidates(roles(spark, sf), page_names(spark, sf)).select("page", "group_id", "index")


def extracted(spark, sf):
    return fields.extract_fields(roles(spark, sf), page_names(spark, sf), controls(spark, sf), bands(spark, sf))


def extract_fields(spark, sf):
    return extracted(spark, sf).select("page", "field_id", F.md5("text").alias("text_md5"), F.md5("section").alias("section_md5"), "item_number", F.array_join("control_kinds", ",").alias("kinds"), "confidence", F.size("options").alias("options"))


def fields_summary(spark, sf):
    return fields.summary(extracted(spark, sf))


def titled(spark, sf):
    """Labels of which some are title lines, some headings."""
    n = F.col("ord")
    text = F.when((n == 2) & (F.col("page") % 4 == 1), F.concat(F.lit("Form: "), "text", F.when(F.col("page") % 8 == 1, " (continued)").otherwise(""))).otherwise(F.col("text"))
    return _placed(spark, sf).select("doc_id", "page", n.cast("int").alias("group_id"), text.alias("text"), "bbox", "size", (n % 13 == 12).alias("markup_only"), F.when((n % 6 == 3) & (F.col("page") % 5 != 0), "SECTION_HEADER").otherwise("QUESTION").alias("role"))


def headers(spark, sf):
    """Markup: a domain header on every third page, a higher one on every sixth, a pointer on the others."""
    p = _pages(spark, sf).select("doc_id", "page")
    note = lambda df, n, text, y: df.select("doc_id", "page", F.lit(n).alias("ord"), text.alias("text"), box(F.lit(60.0), F.lit(y), F.lit(200.0), F.lit(y + 15.0)).alias("bbox"))
    pointer = F.concat(F.lit("See Page "), (F.col("page") % 7).cast("string"), F.lit(", or see pg. "), F.col("page").cast("string"))
    return (note(p.filter("page % 3 = 0"), 0, F.lit("DM=Demographics"), 20.0).unionByName(note(p.filter("page % 6 = 0"), 1, F.lit(" AE = Adverse Events "), 10.0))
            .unionByName(note(p.filter("page % 3 = 1"), 0, pointer, 30.0)))


def page_titles(spark, sf):
    t = forms.page_titles(titled(spark, sf), headers(spark, sf), _pages(spark, sf))
    return t.select("page", "form_name", "raw_title", "form_source", "form_confidence", "form_domain", "is_continuation")


def cross_references(spark, sf):
    more = titled(spark, sf).withColumn("text", F.when(F.col("group_id") == 4, "as in see page 3, see page 3 and See pg. 5").otherwise(F.col("text")))
    r = forms.cross_references(more, headers(spark, sf), _pages(spark, sf))
    return r.select("page", "ord", "target_page", "text", "resolved")


def form_inheritance(spark, sf):
    """Names for turns of conversations; every fourth turn refers to two others."""
    from .text_queries import _titles

    titles = _titles(spark, sf).withColumn("is_continuation", F.lit(False))
    count = titles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    asked = titles.filter((F.col("doc_id") + F.col("page")) % 4 == 0).join(count, "doc_id").select("doc_id", "page", "n", F.posexplode(F.array((F.col("doc_id") * 3 + F.col("page")) % (F.col("n") + 1), F.lit(0))).alias("ord", "t"))
    refs = asked.select("doc_id", "page", "ord", F.col("t").cast("int").alias("target_page"), F.lit("see page").alias("text"), ((F.col("t") != F.col("page")) & (F.col("t") < F.col("n"))).alias("resolved"))
    return forms.inherit_forms(titles, refs).select("doc_id", "page", "form_name", "form_source")


def page_forms(spark, sf):
    """Pages of conversations with their form's domain and continuation mark."""
    from .text_queries import _titles

    named = forms.fill_forward(_titles(spark, sf).withColumn("form_domain", F.when(F.col("page") % 2 == 0, "DM").otherwise("")))
    return forms.page_forms(named, forms.collect_forms(named)).select("doc_id", "page", "form_name", "form_domain", "is_continuation")


def label_keys(spark, sf):
    """Derived text properties of labels."""
    return groups(spark, sf).select("page", "group_id", normalize(F.col("text")).alias("normalized_text"), (F.col("bbox.y1") < PAGE_H / 2).alias("upper_half"))


def queries():
    return {f.__name__: f for f in (anchors_argmin, group_lines, column_of_line, body_lines, page_text, groups_of_role, role_scoring, field_candidates, extract_fields, fields_summary, page_titles, cross_references, form_inheritance, page_forms, label_keys)}
