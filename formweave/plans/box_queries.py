"""Queries over boxes and worksheets: layout, fields, linking, validation, upsert and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import corpus, fields, layout, linking, placement, review
from . import adapters
from .adapters import table

PAGE_W, PAGE_H = 595.0, 842.0


def _pages(spark, sf):
    return table(spark, sf, "documents").select(F.lit("d").alias("doc_id"), F.col("doc_id").alias("page"), F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"))


def _lines(spark, sf):
    return adapters.lines(spark, sf).drop("doc_id").withColumnRenamed("doc", "doc_id")


def _rules(spark, sf):
    """A full-width rule at the top of every third page and one near the bottom of every fourth."""
    p = _pages(spark, sf)
    rule = lambda y: F.struct(F.lit(10.0).alias("x0"), F.lit(y).alias("y0"), F.lit(585.0).alias("x1"), F.lit(y + 1.0).alias("y1"))
    row = lambda df, y, n: df.select("doc_id", "page", F.lit(n).alias("ord"), rule(y).alias("bbox"), F.lit("H").alias("orientation"), F.lit(0.9).alias("span_pct"))
    return row(p.filter("page % 3 = 0"), 100.0, 0).unionByName(row(p.filter("page % 4 = 0"), 760.0, 1))


def _placed(spark, sf):
    """Body lines with a region and the column of their left edge."""
    return _lines(spark, sf).withColumn("region", F.lit("BODY")).withColumn("column", F.when(F.col("bbox.x0") > 200, 1).otherwise(0))


def _shifted(every: int, rest: int, dx: float, dy: float, rows):
    b = F.col("bbox")
    return rows.filter(F.col("ord") % every == rest).withColumn("bbox", F.struct((b.x0 + dx).alias("x0"), (b.y0 + dy).alias("y0"), (b.x1 + dx).alias("x1"), (b.y1 + dy).alias("y1")))


def repeated_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = adapters.lines(spark, sf).drop("doc").join(docs, "doc_id").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("page"), "text", "bbox", "from_annotation")
    pages = docs.select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("page"))
    return layout.repeated_lines(rows, pages, 0.01).select(F.col("doc_id").alias("lang"), "line_text", "line_y", "on_pages")


def region_tagging(spark, sf):
    bounded = layout.body_bounds(_pages(spark, sf), _rules(spark, sf))
    return layout.tag_regions(_lines(spark, sf), bounded).groupBy("page", "region").agg(F.count(F.lit(1)).alias("n"))


def markup_semi_join(spark, sf):
    rows = _placed(spark, sf)
    notes = _shifted(4, 1, 10.0, 2.0, rows)
    return layout.tag_markup(rows, notes).select("page", "ord", F.col("from_annotation"))


def _fields(spark, sf):
    rows = _placed(spark, sf).filter("ord % 2 = 0")
    return rows.select("doc_id", "page", F.format_string("f%d", F.col("ord")).alias("field_id"), F.col("ord").alias("index"), "bbox", "column", "text", F.lit("").alias("form_name"),
                       F.expr("cast(array() as array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,group_id:int>>)").alias("options"))


def _notes(spark, sf):
    rows = _shifted(3, 1, 120.0, 8.0, _placed(spark, sf))
    return rows.select("doc_id", "page", F.format_string("a%d", F.col("ord")).alias("annotation_id"), "ord", "text", "bbox", F.when(F.col("ord") % 2 == 0, "VARIABLE").otherwise("NOTE").alias("annot_type"), F.lit(None).cast("string").alias("domain"), F.when(F.col("ord") % 5 == 1, "DMXX").alias("variable"))


def _candidates(spark, sf):
    forms = _pages(spark, sf).select("doc_id", "page", F.lit("DM").alias("form_domain"))
    bands = _pages(spark, sf).select("doc_id", "page", F.lit(1).alias("index"), F.lit(300.0).alias("x0"), F.lit(PAGE_W).alias("x1"), F.lit("RESPONSE_ZONE").alias("role_hint"))
    return linking.candidates(_notes(spark, sf), _fields(spark, sf), forms, bands)


def link_candidates(spark, sf):
    return _candidates(spark, sf).select("page", "annotation_id", "field_id", F.round("score", 6).alias("score"))


def link_assignment(spark, sf):
    return linking.assign(_candidates(spark, sf)).select("page", "annotation_id", "field_id", "link_score", "rejected")


def unlinked_markup(spark, sf):
    links = linking.assign(_candidates(spark, sf)).withColumn("doc_id", F.col("page"))
    return linking.unlinked_annotations(_notes(spark, sf).withColumn("doc_id", F.col("page")), links).select("page", "annotation_id")


def links_summary(spark, sf):
    return linking.summary(linking.assign(_candidates(spark, sf)))


def links_of_field(spark, sf):
    return linking.links_of(linking.assign(_candidates(spark, sf)), "f2").select("page", "annotation_id", "link_score")


def unlinked_fields(spark, sf):
    """Fields that no accepted link reaches; ids are those of a page here."""
    links = linking.assign(_candidates(spark, sf)).withColumn("doc_id", F.col("page"))
    return linking.unlinked_fields(_fields(spark, sf).withColumn("doc_id", F.col("page")), links).select("page", "field_id")


def section_asof(spark, sf):
    rows = _placed(spark, sf)
    heads = rows.filter("ord % 7 = 0").select("doc_id", "page", F.col("ord").alias("group_id"), "text", "bbox")
    return fields.section_of(rows.select("doc_id", "page", "ord", "bbox"), heads).select("page", "ord", F.md5("section").alias("section_md5"))


def controls_anti(spark, sf):
    rows = _placed(spark, sf)
    controls = _shifted(3, 0, 230.0, 1.0, rows).select("doc_id", "page", "ord", "bbox", F.when(F.col("ord") % 2 == 0, "BOX").otherwise("CIRCLE").alias("kind"))
    bands = _pages(spark, sf).select("doc_id", "page", F.lit(0).alias("index"), F.lit(0.0).alias("x0"), F.lit(PAGE_W).alias("x1"))
    return fields.controls_of(rows.select("doc_id", "page", F.col("ord").alias("index"), "bbox", "column"), controls, bands).select("page", F.col("index").alias("ord"), F.array_join("control_kinds", ",").alias("kinds"))


def option_owner(spark, sf):
    rows = _placed(spark, sf)
    options = rows.filter("ord % 3 = 2").select("doc_id", "page", "ord", "bbox", "column")
    asked = rows.filter("ord % 3 = 0").select("doc_id", "page", F.col("ord").alias("index"), "bbox", "column")
    return fields.option_owners(options, asked).select("page", "ord", "owner")


def detect_columns(spark, sf):
    """Bands of lines in three columns, with controls that tell which of three bands holds answers."""
    from .page_queries import controls

    b, k = F.col("bbox"), F.col("ord") % 3
    x0 = F.when(k == 0, 60.0).when(k == 1, 250.0).otherwise(430.0)
    rows = _placed(spark, sf).withColumn("bbox", F.struct(x0.alias("x0"), b.y0.alias("y0"), (x0 + F.least(b.x1 - b.x0, F.lit(150.0))).alias("x1"), b.y1.alias("y1")))
    return layout.detect_columns(rows, _pages(spark, sf), controls(spark, sf)).select("page", "index", "x0", "x1", "role_hint")


def _sheet(spark, sf):
    """Orders as a returned worksheet with planted faults in most rows."""
    k = F.col("ord")
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (k % m + 1).cast("int"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("ord")).agg(F.min("o_orderpriority").alias("field_text"))
    return orders.select(
        "ord", F.concat(F.lit("r"), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string")).alias("row_id"), F.lit("Medical History").alias("form_name"), "field_text",
        pick(["MHTERM", "DSTERM", "bad-var", "AGE", ""], 5).alias("final_variable"), F.lit("").alias("final_annotation"), pick(["", "VARIABLE", "NOTE", "ODD"], 4).alias("final_annot_type"),
        pick(["APPROVED", "REJECTED", "AUTO", "", "approved", "DONE"], 6).alias("status"), F.when(k % 4 == 0, "no").otherwise("").alias("reviewer_note"), pick(["#D91A1A", "red", "", "00ff00"], 4).alias("color_rgb"), F.lit("Helv").alias("font_name"),
        pick(["8.0", "30", "big", ""], 4).alias("font_size"), pick(["right_of_field", "nowhere", ""], 3).alias("placement"), F.lit("MHTERM").alias("suggested_variable"), F.lit("").alias("suggested_annotation"), F.lit("EXACT_KEY").alias("match_tier"))


def _blank(spark, sf):
    """The blank form's fields: some rows of the sheet have none, some were altered, some moved."""
    k = F.col("ord")
    label = F.when(k % 19 == 0, F.concat("field_text", F.lit(" changed"))).otherwise(F.col("field_text"))
    y = k % 60 * 10.0
    box = F.struct(F.lit(60.0).alias("x0"), y.alias("y0"), F.lit(160.0).alias("x1"), (y + 10).alias("y1"))
    return _sheet(spark, sf).filter("ord % 17 <> 0").select(F.lit("d").alias("doc_id"), F.concat(F.lit("r"), k.cast("string")).alias("field_id"), (k % 5 + 1).cast("int").alias("page"), label.alias("text"), F.when(k % 29 == 0, "Vital Signs").otherwise("Medical History").alias("form_name"), box.alias("bbox"))


def _imported(spark, sf):
    sheet, k = _sheet(spark, sf), F.col("ord")
    geometry = sheet.filter("ord % 13 <> 0").select("ord", "row_id", F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), (k % 23 / 20).alias("rel_x_pct"), F.lit(0.5).alias("rel_y_pct"), F.lit(0.1).alias("rel_w_pct"), F.lit(0.02).alias("rel_h_pct"),
                                                    (k % 5 / 100).alias("offset_x_pct"), (k % 7 / 100).alias("offset_y_pct"), (k % 9).cast("string").alias("page"))
    formulas = sheet.filter("ord % 2 = 0").select("ord", F.when(k % 10 == 4, "=B2").alias("final_variable"), F.lit(None).cast("string").alias("final_annotation"), F.when(k % 4 == 0, "=A1").alias("status"))
    domains = spark.createDataFrame([("medical history", "mh")], "form_key string, domain string")
    return sheet, review.validate(sheet, geometry, _blank(spark, sf), domains, formulas)


def validate_rows(spark, sf):
    _, rows = _imported(spark, sf)
    return rows.select("ord", "ok", "ready", F.array_join(F.transform("issues", lambda i: i.code), ",").alias("codes"))


def import_report(spark, sf):
    _, rows = _imported(spark, sf)
    return review.counts_by(review.all_issues(rows), "code")


def import_totals(spark, sf):
    _, rows = _imported(spark, sf)
    return review.report(rows, review.all_issues(rows, review.missing_rows(_blank(spark, sf), rows)))


def missing_rows(spark, sf):
    sheet, rows = _imported(spark, sf)
    asked = sheet.select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("field_id"), F.col("field_text").alias("text"))
    return review.missing_rows(asked, rows).select("row_id", "code")


def missing_sheets(spark, sf):
    names = table(spark, sf, "nation").filter("n_nationkey = 3").select(F.lit("Geometry").alias("sheet"))
    return review.missing_sheets(names).select("column", "severity", "code")


def review_copy(spark, sf):
    sheet, rows = _imported(spark, sf)
    copy = review.review_copy(sheet, rows)
    return copy.select("ord", F.size(F.regexp_extract_all("import_issues", F.lit(r"\[(ERROR|WARNING)\] "), 1)).alias("parts"), (F.col("import_issues") == "").alias("clean"), "blocked")


def learned_annotations(spark, sf):
    """What approved and rejected rows teach: annotations where they would be drawn."""
    a = _learned(spark, sf)["annotations"]
    return a.select("annotation_id", "text", "annot_type", "variable", "form_name", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def _learned(spark, sf):
    _, rows = _imported(spark, sf)
    pages = spark.range(1, 6).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"))
    return review.learned_rows(rows, _blank(spark, sf), pages, "reviewed")


def learned_links(spark, sf):
    return _learned(spark, sf)["links"].select("doc_id", "page", "field_id", "link_score", "trust", "rejected")


def learned_fields(spark, sf):
    """Every field is stored, under the form that the reviewer named."""
    return _learned(spark, sf)["fields"].groupBy("doc_id", "form_name").agg(F.count(F.lit(1)).alias("n"))


def write_reasons(spark, sf):
    """Why rows are not drawn: checks, status, or a page that the document lacks."""
    _, rows = _imported(spark, sf)
    text = rows.withColumn("annotation_text", F.col("annotation_text"))
    _, skipped = placement.write_plan(text, 5)
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def placement_anchored(spark, sf):
    """Where rows are drawn: every placement, sizes that are missing, fonts that are replaced."""
    k, n = F.col("p_partkey"), F.col("p_size")
    at = F.element_at(F.array(*map(F.lit, ("right_of_field", "left_of_field", "above_field", "below_field", "overlapping_field", ""))), (k % 6 + 1).cast("int"))
    font = F.element_at(F.array(*map(F.lit, ("Helv", " Arial-Bold ", "Fancy", "", "times"))), (k % 5 + 1).cast("int"))
    geometry = F.struct(F.lit("595").alias("page_width"), F.lit("842").alias("page_height"), (k % 20 / 20).alias("rel_x_pct"), (n % 50 / 50).alias("rel_y_pct"), F.lit(0.1).alias("rel_w_pct"), F.lit(0.02).alias("rel_h_pct"), (k % 4 / 100).alias("offset_x_pct"), (k % 3 / 100).alias("offset_y_pct"))
    rows = table(spark, sf, "part").select(k.alias("row_id"), geometry.alias("geometry"), F.col("p_brand").alias("annotation_text"), (n % 3 * 4).cast("double").alias("font_size"), at.alias("placement"), font.alias("font_name"))
    r = placement.anchored(rows)
    return r.select("row_id", "rect.x0", "rect.y0", "rect.x1", "rect.y1", F.size("adjustments").alias("notes"), placement.base_font(F.col("font_name")).font.alias("font"))


def upsert_replace(spark, sf):
    f = adapters.facts(spark, sf).select(F.col("file_name").alias("path"), "field_key", "variable", "ord")
    new = f.filter("path rlike '[05]$'").withColumn("variable", F.concat(F.lit("NEW"), "variable"))
    return corpus.replace_by_key(f, new).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("variable").alias("first_variable"))


def placement_clamp(spark, sf):
    b = F.struct((F.col("p_size") * 14.0 - 40).alias("x0"), (F.col("p_partkey") % 90 * 10.0 - 20).alias("y0"), (F.col("p_size") * 14.0 - 40 + F.col("p_partkey") % 7 * 100 + 30).alias("x1"), (F.col("p_partkey") % 90 * 10.0 - 5).alias("y1"))
    c = G.clamp(F.col("b"), F.lit(PAGE_W), F.lit(PAGE_H))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), b.alias("b")).select("id", c.alias("c")).select("id", "c.rect.x0", "c.rect.y0", "c.rect.x1", "c.rect.y1", F.size("c.notes").alias("notes"))


def collision_nudge(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").groupBy(k.alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    x, y = (k % 5 * 40.0), (k % 11 * 30.0)
    rows = rows.select(F.lit("d").alias("doc_id"), F.expr("o_orderkey div 20").alias("page"), F.concat(F.lit("r"), k.cast("string")).alias("row_id"), (y / PAGE_H).alias("rel_y"), F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 20).alias("y1")).alias("rect"),
                       F.lit(PAGE_H).alias("page_height"), F.array().cast("array<string>").alias("adjustments"))
    return placement.avoid_collisions(rows).select("page", "row_id", "rect.x0", "rect.y0", F.size("adjustments").alias("moves"))


def queries():
    return {f.__name__: f for f in (repeated_lines, region_tagging, markup_semi_join, link_candidates, link_assignment, links_summary, links_of_field, unlinked_markup, unlinked_fields, section_asof, controls_anti, option_owner, detect_columns, validate_rows, import_report, import_totals, missing_rows, missing_sheets, review_copy,
                                    learned_annotations, learned_links, learned_fields, write_reasons, placement_anchored, upsert_replace, placement_clamp, collision_nudge)}
