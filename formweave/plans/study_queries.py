"""Queries over a stored corpus made from line items, and over a study made from document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import normalize
from ..operators import corpus, forms, prefill, staging, style, template
from ..sources import extracted, knowledge, workbook
from ..sources.scratch import scratch_dir
from . import adapters, fact_queries
from .adapters import table
from .box_queries import PAGE_H, PAGE_W, _candidates, _fields, _notes, _pages, _placed
from .page_queries import box


def corpus_tables(spark, sf):
    """Suppliers as studies with one form each, line items as fields with one annotation.

    The forms of some nations are missing, and so are some annotations, which leaves links without an end.
    """
    f = adapters.facts(spark, sf).withColumns({"doc_id": F.col("file_name"), "field_id": F.concat(F.lit("f"), F.col("ord").cast("string")), "annotation_id": F.concat(F.lit("a"), F.col("ord").cast("string"))})
    nations = table(spark, sf, "nation").withColumn("domain", adapters.nation_domain(F.col("n_nationkey")))
    suppliers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    y = F.col("page") * 20.0
    field_box, mark_box = box(F.lit(60.0), y, F.lit(160.0), y + 10), box(160 + F.col("offset_x_pct") * 100, y + F.col("offset_y_pct") * 300, 220 + F.col("offset_x_pct") * 100, y + 10 + F.col("offset_y_pct") * 300)
    return {
        "documents": suppliers.select(F.col("s_name").alias("doc_id"), F.concat(F.lit("/in/"), "s_name").alias("path"), F.col("s_name").alias("file_name"), F.lit(7).alias("page_count")),
        "pages": suppliers.select(F.col("s_name").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"), F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height")),
        "forms": suppliers.filter("n_nationkey % 6 <> 5").select(F.col("s_name").alias("doc_id"), F.upper("n_name").alias("name"), "domain", F.array(F.lit(1)).alias("pages"), F.lit(0.9).alias("confidence"), F.lit("TITLE_LINE").alias("source")),
        "fields": f.select("doc_id", "field_id", "page", F.concat("form_name", F.lit(" ")).alias("form_name"), F.col("field_text").alias("text"), F.lit(0.5).alias("confidence"), field_box.alias("bbox")),
        "annotations": f.filter(F.col("ord") % 50 != 0).select("doc_id", "annotation_id", "page", F.col("ord").alias("ord"), F.col("annotation_text").alias("text"), "annot_type", "variable", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("qnam"), mark_box.alias("bbox"),
                                                                F.array(F.col("font_size") / 25, F.lit(0.2), F.lit(0.2)).alias("text_color"), "font_name", "font_size"),
        "links": f.select("doc_id", "page", "field_id", "annotation_id", "link_score", "trust", "rejected"),
    }


def _stored(spark, sf):
    return knowledge.stored_tables(corpus_tables(spark, sf))


def facts_join(spark, sf):
    t = corpus_tables(spark, sf)
    rows = corpus.accepted(corpus.facts(t["documents"], t["forms"], t["fields"], t["annotations"], t["links"]))
    return rows.select("file_name", "form_name", "domain", "field_key", "field_text", "normalized_text", "variable", "link_score", "trust", "field_confidence", F.col("ord.field_id").alias("field_id"))


def view_field_annotations(spark, sf):
    v = knowledge.view_frames(_stored(spark, sf), spark)["field_annotations"]
    return v.select("file_name", "form_name", "field_key", "annotation_text", "link_score", "trust", "field_id")


def view_rejected_suggestions(spark, sf):
    return knowledge.view_frames(_stored(spark, sf), spark)["rejected_suggestions"]


def view_field_map(spark, sf):
    return knowledge.view_frames(_stored(spark, sf), spark)["field_map"].select("field_key", "form_name", "field_text", "occurrences", "variants", "variables", "best_link_score")


def forms_list(spark, sf):
    return corpus_tables(spark, sf)["forms"].select("name", "domain", F.size("pages").alias("pages"), "confidence").orderBy("name")


def point_lookups(spark, sf):
    """A page, a form by its name in another spelling, an annotation and a field."""
    t = corpus_tables(spark, sf)
    first = t["documents"].agg(F.min("doc_id").alias("doc_id"))  # one row
    own = lambda name: t[name].join(F.broadcast(first), "doc_id")
    page = corpus.point(own("pages"), page=3).select(F.lit("page").alias("what"), F.col("page").cast("string").alias("found"))
    named = corpus.form_named(t["forms"], " nation_7 ").agg(F.count(F.lit(1)).cast("string").alias("found")).select(F.lit("form").alias("what"), "found")
    missing = corpus.point(own("fields"), field_id="none").select(F.lit("field").alias("what"), F.col("field_id").alias("found"))
    return page.unionByName(named).unionByName(missing)


def link_rows(spark, sf):
    """Stored links with their placement; some have no field or no annotation any more."""
    links = _candidates(spark, sf).withColumns({"rejected": F.lit(False), "relative_label": F.lit(None), "offset_x_pct": F.lit(None), "offset_y_pct": F.lit(None), "doc_id": F.col("page").cast("string")})
    of = lambda df, keep: df.withColumn("doc_id", F.col("page").cast("string")).filter(keep)
    rows = corpus.link_rows(links, of(_fields(spark, sf), "index % 10 <> 4"), of(_notes(spark, sf), "ord % 21 <> 4"), of(_pages(spark, sf), "true"))
    return rows.select("page", "annotation_id", "field_id", "relative_label", "offset_x_pct", "offset_y_pct")


def index_from_documents(spark, sf):
    return prefill.exact_winners(prefill.index_from_documents(corpus_tables(spark, sf))).select("form_key", "normalized_text", "confidence", "variable")


def style_of_corpus(spark, sf):
    s = style.style_of_corpus(corpus_tables(spark, sf)["annotations"], _stored(spark, sf)["links"])
    return s.select("scope", "samples", "font_size", "size_agreement", "font_name", "font_agreement", "placement", "placement_agreement", "settled", F.element_at("text_color", 1).alias("red"))


def style_for_type(spark, sf):
    """The rule of each type: its own, or the default where it has too few samples or none."""
    wanted = spark.createDataFrame([("VARIABLE",), ("NOTE",), ("DERIVATION_RULE",)], "annot_type string")
    rows = fact_queries._acc(spark, sf).withColumn("annot_type", F.when(F.col("ord") % 100_000 == 7, "NOTE").otherwise("VARIABLE"))
    rule = style.rule_for(wanted, style.house_style(rows, rows))
    return rule.select("annot_type", "rule.font_size", "rule.placement", F.col("rule.samples").alias("samples"))


def unsettled_rules(spark, sf):
    return style.unsettled(fact_queries.house(spark, sf)).select("scope", "samples")


def _staged(spark, sf):
    f = fact_queries._fields(spark, sf)
    n = F.length("text").cast("double")
    rows = f.select("doc_id", "field_id", "form_name", F.lit(1).alias("page"), "text", F.concat(F.length("text").cast("string"), F.lit(".")).alias("item_number"), F.array(F.struct(F.col("domain").alias("text")), F.struct(F.lit("other").alias("text"))).alias("options"),
                    F.array(F.lit("BOX"), F.lit("CIRCLE")).alias("control_kinds"), box(F.lit(60.0), 100 + n, 60 + 5 * n, 110 + n).alias("bbox"), F.lit(3).alias("group_id"), F.lit(0.5).alias("confidence"))
    rows_of_style = fact_queries._acc(spark, sf).withColumn("text_color", F.array(F.col("font_size") / 25, F.lit(0.2), F.lit(0.2)))
    house = style.house_style(rows_of_style, rows_of_style)
    pages = f.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"))
    return staging.build_staging(rows, fact_queries._tiers(spark, sf, with_fuzzy=False), house, pages), house


def staging_rows(spark, sf):
    s, _ = _staged(spark, sf)
    return s.select("row_id", "item_number", "options", "control", "suggested_variable", "match_tier", "match_score", "match_source", "known_aliases", "final_variable", "final_annot_type", "status", "color_rgb", "font_size", "placement",
                    F.col("geometry.rel_x_pct").alias("rel_x"), F.col("geometry.rel_y_pct").alias("rel_y"), F.col("geometry.rel_w_pct").alias("rel_w"), F.col("geometry.offset_x_pct").alias("offset_x"))


def staging_summary(spark, sf):
    return staging.summary(_staged(spark, sf)[0])


def worksheet_files(spark, sf):
    """Nations as a worksheet: written as a workbook, read back by column names."""
    rows = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("row_id"), F.col("n_name").alias("field_text"), F.lit("AUTO").alias("status"), (F.col("n_nationkey") / 4).alias("font_size")).orderBy("n_nationkey")
    data = workbook.workbook_bytes({"Annotations": rows})
    values, _ = workbook.sheet_frames(spark, workbook.read_workbook(data)["Annotations"], ["row_id", "status", "field_text", "font_size"])
    return values.select("ord", "row_id", "field_text", "status", F.col("font_size").cast("double").alias("font_size"))


def _study(spark, sf, whole=False):
    """Documents of four groups as studies: their lines as fields, every sixth with an annotation.

    ``whole``: all lines, labelled by their whole text; otherwise the first 20, labelled by their first word.
    """
    placed = _placed(spark, sf)
    # the SQL's trim strips every kind of space, Spark's the blank only
    placed, word = (placed.filter(F.col("text").rlike(r"\P{Zs}")), F.col("text")) if whole else (placed.filter("ord < 20"), F.split("text", " ")[0])
    rows = placed.withColumns({"doc_id": F.concat(F.lit("s"), (F.col("page") % 4).cast("string")), "form_name": F.concat(F.lit("Form "), (F.col("page") % 3).cast("string")), "word": word})
    all_pages = _pages(spark, sf).withColumn("doc_id", F.concat(F.lit("s"), (F.col("page") % 4).cast("string")))
    named = all_pages.select("doc_id", "page", F.concat(F.lit("Form "), (F.col("page") % 3).cast("string")).alias("form_name"), F.lit("TITLE_LINE").alias("form_source"), F.lit(0.95).alias("form_confidence"), F.lit("DM").alias("form_domain"), F.array(F.lit("t")).alias("form_evidence"), F.lit("t").alias("raw_title"))
    f = rows.filter("ord % 2 = 0").select(
        "doc_id", "page", F.col("ord").cast("int").alias("index"), F.format_string("p%df%d", "page", F.col("ord").cast("long")).alias("field_id"), "form_name", F.col("word").alias("text"), F.col("text").alias("raw_text"), normalize(F.col("word")).alias("normalized_text"), "bbox",
        F.lit("").alias("item_number"), F.lit("").alias("section"), F.lit("QUESTION").alias("role"), (0.5 + F.col("ord") % 5 / 10).alias("confidence"), F.array(F.when(F.col("ord") % 4 == 0, "BOX").otherwise("CIRCLE")).alias("control_kinds"),
        F.expr("cast(array() as array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>)").alias("options"))
    # the SQL's test of a whole text is for a letter, digit or underscore in it as it is, not as it is folded
    f = f.filter(F.col("text").rlike(r"[\p{L}\p{N}_]") if whole else F.col("normalized_text") != "")
    marked = rows.filter("ord % 6 = 0")
    b = F.col("bbox")
    code = F.substring("word", 1, 4)
    a = marked.select("doc_id", "page", F.col("ord").cast("int").alias("ord"), F.format_string("p%da%d", "page", F.col("ord").cast("long")).alias("annotation_id"), code.alias("text"), box(b.x1 + 20, b.y0 + 3, b.x1 + 60, b.y1 + 3).alias("bbox"), F.lit("VARIABLE").alias("annot_type"), code.alias("variable"),
                      *(F.lit(None).cast("string").alias(c) for c in ("domain", "value", "qnam")), F.lit(0.8).alias("type_confidence"), F.lit(None).cast("array<struct<part_text:string,annot_type:string,variable:string>>").alias("statement_list"))
    links = marked.select("doc_id", "page", F.format_string("p%df%d", "page", F.col("ord").cast("long")).alias("field_id"), F.format_string("p%da%d", "page", F.col("ord").cast("long")).alias("annotation_id"), F.lit(0.9).alias("link_score"), (F.col("page") % 10 == 0).alias("rejected"))
    documents = all_pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count")).withColumn("file_name", F.concat("doc_id", F.lit(".v1.pdf")))
    return {"documents": documents, "pages": all_pages, "forms": forms.collect_forms(named), "fields": f, "annotations": a, "links": links}


def _entries(t):
    return template.merge_by_key(template.field_entries(t["fields"], t["forms"], t["pages"], t["links"], t["annotations"]))


def template_entries(spark, sf):
    e = _entries(_study(spark, sf))
    return e.select("doc_id", "form_key", "normalized_text", "field_text", "occurrences", F.array_join("page_offsets", ",").alias("offsets"), F.bround("confidence", 2).alias("confidence"), "position.rel_x_pct", "position.rel_y_pct", F.array_join("control_kinds", ",").alias("kinds"),
                    F.size("annotations").alias("notes"), F.get("annotations", F.lit(0)).text.alias("note"), F.get("annotations", F.lit(0)).placement.relative_label.alias("label"))


def _flat(t):
    rows = t.select("doc_id", "template_version", "name", F.explode("forms").alias("f"))
    return rows.select("doc_id", "template_version", "name", F.col("f.normalized_name").alias("form"), F.col("f.page_count").alias("pages"), F.size("f.continuation_offsets").alias("continued"), F.size("f.fields").alias("fields"))


def template_build(spark, sf):
    t = _study(spark, sf)
    return _flat(template.build_template(t["documents"], _entries(t), t["forms"]))


def template_files(spark, sf):
    """The templates saved as JSON and loaded again."""
    t, folder = _study(spark, sf), scratch_dir(spark, "templates")
    template.save_templates(template.build_template(t["documents"], _entries(t), t["forms"]), folder)
    return _flat(template.load_templates(spark, folder))


def _applied(spark, sf):
    t = _study(spark, sf)
    one = lambda name, doc: t[name].filter(F.col("doc_id") == doc)
    return template.apply_template(_entries(t).filter("doc_id = 's0'"), one("fields", "s1"), one("forms", "s1"), one("pages", "s1"))


def template_apply(spark, sf):
    return _applied(spark, sf).select("field_id", "method", "confidence", F.size("annotations").alias("notes"))


def template_loaded_apply(spark, sf):
    """As ``template_apply``, with the entries of a template that was saved and loaded."""
    t, folder = _study(spark, sf), scratch_dir(spark, "templates")
    template.save_templates(template.build_template(t["documents"], _entries(t), t["forms"]), folder)
    one = lambda name, doc: t[name].filter(F.col("doc_id") == doc)
    loaded = template.entries_of(template.load_templates(spark, folder)).filter("doc_id = 's0'")
    return template.apply_template(loaded, one("fields", "s1"), one("forms", "s1"), one("pages", "s1")).select("field_id", "method", "confidence", F.size("annotations").alias("notes"))


def template_summary(spark, sf):
    return template.summary(_applied(spark, sf))


def json_files(spark, sf):
    """The study of whole texts as JSON objects, read back; a document's objects are counted together."""
    t, folder = _study(spark, sf, whole=True), scratch_dir(spark, "json")
    extracted.dump_json(t, folder, compression="gzip")
    total = lambda rows, name: F.sum(F.coalesce(F.size(rows), F.lit(0))).cast("int").alias(name)
    return extracted.load_json(spark, folder, t).groupBy("doc_id").agg(F.max("file_name").alias("file_name"), *(total(F.col(c), c) for c in ("forms", "fields", "links")), total(F.filter("links", lambda x: x.rejected), "rejected"))


def box_geometry(spark, sf):
    """Boxes of parts: ordered corners, size, relation to a second box, and place on the page."""
    k, n = F.col("p_partkey"), F.col("p_size")
    a = G.box(k % 50 * 7.0 + 0.123, n * 3.0, n * 5.0, k % 31 * 4.0 + 0.456, 2)
    b = G.box(n * 6.0, k % 17 * 5.0, n * 6.0 + 40, k % 17 * 5.0 + 30)
    rows = table(spark, sf, "part").select(k.alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    r = G.relative(a, F.lit(PAGE_W), F.lit(PAGE_H))
    return rows.select("id", "a.x0", "a.y0", "a.x1", "a.y1", F.bround(G.width(a), 3).alias("w"), F.bround(G.height(a), 3).alias("h"), F.bround(G.area(a), 3).alias("area"), F.bround(G.cx(a), 3).alias("cx"), F.bround(G.v_overlap(a, b), 6).alias("v"),
                       F.bround(G.h_overlap(a, b), 6).alias("o"), F.bround(G.inside(a, b), 6).alias("inside"), G.near(a, b, 30.0).alias("near"), G.in_band(a, F.lit(50.0), F.lit(150.0)).alias("banded"), r.rel_x_pct.alias("rel_x"), r.rel_h_pct.alias("rel_h"), G.relative_label(a, b).alias("label"))


def queries():
    return {f.__name__: f for f in (facts_join, view_field_annotations, view_rejected_suggestions, view_field_map, forms_list, point_lookups, link_rows, index_from_documents, style_of_corpus, style_for_type, unsettled_rules, staging_rows, staging_summary, worksheet_files,
                                    template_entries, template_build, template_files, template_apply, template_loaded_apply, template_summary, json_files, box_geometry)}
