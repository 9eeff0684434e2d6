"""Corpus, pre-fill, style, template, review and placement on the studies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from formweave.operators import corpus, placement, prefill, review, staging, style, template


@pytest.fixture(scope="module")
def past(spark, study, second):
    names = ("documents", "forms", "fields", "annotations", "links", "pages")
    return {n: spark.createDataFrame(study[n].select(*[c for c in study[n].columns if c in second[n].columns]).unionByName(second[n].select(*[c for c in study[n].columns if c in second[n].columns])).collect(), study[n].schema) for n in names}


@pytest.fixture(scope="module")
def rows(spark, past):
    df = corpus.facts(past["documents"], past["forms"], past["fields"], past["annotations"], past["links"])
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def house(spark, past):
    notes = past["annotations"]
    placed = corpus.link_rows(past["links"].filter("NOT rejected"), past["fields"], notes, past["pages"]).drop("annot_type").join(notes.select("doc_id", "annotation_id", "annot_type"), ["doc_id", "annotation_id"])
    df = style.house_style(notes.withColumn("ord", F.struct("doc_id", "page", "ord")), placed.withColumn("ord", F.struct("doc_id", "page", "annotation_id")))
    return spark.createDataFrame(df.collect(), df.schema)


def blank_fields(blank):
    return blank["fields"].join(blank["forms"].select("doc_id", F.col("name").alias("form_name"), "domain"), ["doc_id", "form_name"], "left")


@pytest.fixture(scope="module")
def filled(spark, rows, past, blank):
    df = prefill.prefill(blank_fields(blank), corpus.accepted(rows), corpus.rejected_suggestions(rows), past["forms"])
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def sheet(spark, filled, house, blank):
    df = staging.build_staging(blank["fields"], filled, house, blank["pages"])
    return spark.createDataFrame(df.collect(), df.schema)


def test_stats(study):
    rows = corpus.accepted(corpus.facts(study["documents"], study["forms"], study["fields"], study["annotations"], study["links"]))
    got = corpus.stats(study["documents"], study["forms"], study["fields"], study["annotations"], study["links"], rows).first().asDict()
    assert got == {"documents": 1, "forms": 4, "fields": 14, "annotations": 17, "links": 9, "mapped_keys": 9}


def test_lookup(rows):
    acc = corpus.accepted(rows)
    found = lambda form: [r.variable for r in corpus.lookup(acc, form, "Start Date").collect()]
    assert (found("Medical History"), found("Adverse Events"), found("Demographics")) == (["MHSTDTC"], ["AESTDTC"], [])


def test_prefill_of_blank_form(filled):
    got = prefill.summary(filled).first()
    assert (got.fields, got.auto, got.auto_fill_rate) == (14, 9, 0.643)


def test_suffixes(rows):
    got = {(r.normalized_text, r.suffix): r.domains for r in prefill.suffixes(corpus.accepted(rows)).collect()}
    assert got[("start date", "STDTC")] == ["AE", "MH"] and got[("stop date", "ENDTC")] == ["AE", "MH"]


def test_unseen_form_gets_the_convention(spark, rows):
    field = spark.createDataFrame([("d", "p1f0", "Concomitant Medications", "Start Date", "CM")], "doc_id string, field_id string, form_name string, text string, domain string")
    got = prefill.prefill(field, corpus.accepted(rows)).first()
    assert (got.best.tier, got.best.variable, got.status) == ("DOMAIN_PATTERN", "CMSTDTC", "NEEDS_REVIEW")


def test_house_style(study, house):
    own = style.house_style(study["annotations"].withColumn("ord", F.struct("page", "ord")), corpus.link_rows(study["links"].filter("NOT rejected"), study["fields"], study["annotations"], study["pages"]).drop("annot_type")
                            .join(study["annotations"].select("doc_id", "annotation_id", "annot_type"), ["doc_id", "annotation_id"]).withColumn("ord", F.struct("page", "annotation_id")))
    got = {r.scope: r for r in own.collect()}
    assert (got["*"].samples, got["*"].color_agreement) == (17, 1.0)
    assert got["VARIABLE"].samples == 7 and got["VARIABLE"].settled
    assert got["DOMAIN_HEADER"].size_agreement == 0.5 and not got["DOMAIN_HEADER"].settled


def test_template_round_trip(study, blank):
    entries = template.merge_by_key(template.field_entries(study["fields"], study["forms"], study["pages"], study["links"], study["annotations"]))
    assert entries.count() == 13
    names = {a.variable for r in entries.collect() for a in r.annotations if a.variable}
    assert names == {"AGE", "BRTHDTC", "MHENDTC", "MHENRF", "MHSTDTC", "MHTERM", "QVAL", "RACE", "SEX"}
    matches = template.apply_template(entries, blank["fields"], blank["forms"], blank["pages"])
    assert Counter(r.method for r in matches.collect()) == {"EXACT_KEY": 13, "TEXT_ONLY": 1}
    assert template.build_template(study["documents"], entries, study["forms"]).first().forms[0].fields


def returned(sheet, spark, **edits):
    """The worksheet with AUTO rows approved, as text."""
    cols = ["doc_id", *staging.COLUMNS]
    df = sheet.select(*(F.col(c).cast("string").alias(c) for c in cols)).withColumn("ord", F.monotonically_increasing_id()).withColumn("status", F.when(F.col("status") == "AUTO", "APPROVED").otherwise(F.col("status")))
    for c, v in edits.items():
        df = df.withColumn(c, v)
    return df


def geometry(sheet):
    return sheet.select("row_id", F.lit(0).alias("ord"), "page", "geometry.*")


def test_import_of_approved_sheet(spark, sheet, blank):
    rows = review.validate(returned(sheet, spark), geometry(sheet), blank["fields"])
    assert (rows.count(), review.approved(rows).count(), review.blocked(rows).count()) == (14, 9, 0)
    assert Counter(r.status for r in rows.collect()) == {"APPROVED": 9, "NEEDS_MAPPING": 5}
    placed, skipped = placement.write_plan(rows, 5)
    assert (placed.count(), skipped.count(), placed.filter("size(adjustments) > 0").count()) == (9, 5, 0)


@pytest.mark.parametrize("edit,code", [
    ({"status": ""}, "MISSING_STATUS"), ({"status": "DONE"}, "BAD_STATUS"), ({"color_rgb": "red"}, "BAD_COLOR"), ({"color_rgb": ""}, "MISSING_COLOR"), ({"font_size": "big"}, "BAD_FONT_SIZE"),
    ({"font_size": "99"}, "BAD_FONT_SIZE"), ({"placement": "nowhere"}, "BAD_PLACEMENT"), ({"final_variable": "not a var"}, "BAD_VARIABLE"), ({"final_annot_type": "ODD"}, "BAD_ANNOT_TYPE"),
    ({"field_text": "Edited"}, "ROW_ALTERED"), ({"row_id": "p9f9"}, "UNKNOWN_ROW_ID"), ({"row_id": "p1f0"}, "DUPLICATE_ROW_ID"), ({"final_annotation": "", "final_variable": ""}, "MISSING_DECISION"),
    ({"form_name": "Other"}, "FORM_RENAMED"), ({"final_annot_type": "NOTE"}, "TYPE_MISMATCH"), ({"final_variable": "DSTERM"}, "DOMAIN_MISMATCH"), ({"status": "REJECTED"}, "NO_REJECT_REASON")])
def test_fault_injection(spark, sheet, blank, edit, code):
    domains = spark.createDataFrame([("medical history", "MH"), ("demographics", "DM")], "form_key string, domain string")
    rows = review.validate(returned(sheet, spark, **{c: F.lit(v) for c, v in edit.items()}), geometry(sheet), blank["fields"], domains)
    assert code in {i.code for r in rows.collect() for i in r.issues}


def test_missing_rows_and_geometry(spark, sheet, blank):
    rows = review.validate(returned(sheet, spark).filter("row_id <> 'p1f0'"), geometry(sheet).filter("row_id <> 'p1f1'").withColumn("rel_x_pct", F.when(F.col("row_id") == "p1f2", 7.0).otherwise(F.col("rel_x_pct"))), blank["fields"])
    assert [r.row_id for r in review.missing_rows(blank["fields"], rows).collect()] == ["p1f0"]
    codes = {r.row_id: [i.code for i in r.issues] for r in rows.collect()}
    assert "MISSING_GEOMETRY" in codes["p1f1"] and "BAD_GEOMETRY" in codes["p1f2"]


def test_learning_leaves_fewer_rows(spark, sheet, blank, rows):
    """A reviewer decides three of the five open rows; the next pre-fill has two."""
    opened = [r.row_id for r in sheet.filter("status = 'NEEDS_MAPPING'").orderBy("row_id").collect()]
    decided = F.col("row_id").isin(opened[:3])
    edited = returned(sheet, spark).withColumn("status", F.when(decided, "APPROVED").otherwise(F.col("status"))).withColumn("final_annotation", F.when(decided, "IETESTCD").otherwise(F.col("final_annotation")))
    imported = review.validate(edited, geometry(sheet), blank["fields"])
    learned = review.learned_rows(imported, blank["fields"], blank["pages"], "blank reviewed")
    docs = spark.createDataFrame([("blank reviewed", "blank reviewed")], "doc_id string, file_name string")
    forms = blank["forms"].withColumn("doc_id", F.lit("blank reviewed"))
    more = corpus.facts(docs, forms, learned["fields"], learned["annotations"], learned["links"])
    both = rows.unionByName(more)
    again = prefill.prefill(blank_fields(blank), corpus.accepted(both))
    assert prefill.summary(again).first().reaches_agent <= 2


def test_rejected_suggestion_is_not_offered_again(spark, blank, rows):
    no = spark.createDataFrame([("demographics|age", "AGE", "AGE", "f")], "field_key string, annotation_text string, variable string, file_name string")
    got = {r.text: r for r in prefill.prefill(blank_fields(blank), corpus.accepted(rows), no).collect()}["Age"]
    assert (got.best.tier, got.best.confidence, got.status) == ("EXACT_KEY", 0.0, "NEEDS_MAPPING")


def test_workbook_round_trip(spark, sheet, blank, tmp_path):
    from formweave.sources import workbook

    path = str(tmp_path / "form.xlsx")
    workbook.write_sheets(path, {"Annotations": sheet.select(*staging.COLUMNS), "Geometry": sheet.select("row_id", "page", "geometry.*")}, {"Annotations": {"status": staging.STATUSES}}, ["Fill in the status."])
    back = workbook.read_workbook(path)
    assert set(back) == {"Annotations", "Geometry", "Instructions"} and len(back["Annotations"]) == 14
    values, formulas = workbook.sheet_frames(spark, back["Annotations"], staging.COLUMNS)
    geo, _ = workbook.sheet_frames(spark, back["Geometry"], staging.GEOMETRY)
    rows = review.validate(values, geo, blank["fields"], None, formulas)
    assert rows.count() == 14 and review.blocked(rows).count() == 0


def test_replacing_a_document(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, n int")
    new = spark.createDataFrame([("a", 2), ("a", 3)], "path string, n int")
    assert sorted(map(tuple, corpus.replace_by_key(old, new).collect())) == [("a", 2), ("a", 3), ("b", 1)]


def test_arrivals_replace_documents(spark, tmp_path):
    from formweave.streaming.arrivals import replace_arrivals

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame([("a", n), ("a", n)] if n == 1 else [("a", n)], "doc_id string, n int").coalesce(1).write.mode("append").parquet(src)
        replace_arrivals(spark, src, "doc_id string, n int", out, str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).select("doc_id", "n").collect()] == [("a", 2)]


def pushed_down(boxes, page_height):
    """Box after box, each pushed below any earlier one that it meets until it meets none."""
    out = []
    for x0, y0, x1, y1 in boxes:
        start = y0
        while hit := next((b for b in out if min(x1, b[2]) > max(x0, b[0]) and min(y1, b[3]) > max(y0, b[1])), None):
            y0, y1 = hit[3] + 2, y1 + hit[3] + 2 - y0
        if y0 > start:
            over = max(0.0, y1 - (page_height - 2))
            y0, y1 = y0 - over, y1 - over
            y0, y1 = (2.0, y1 + 2 - y0) if y0 < 2 else (y0, y1)
        out.append(tuple(round(v, 2) for v in (x0, y0, x1, y1)))
    return out


def test_nudged_boxes_do_not_touch():
    import random

    def placed(boxes, height):
        page = placement.PageColumn()
        return [page.place(*b, height)[0] for b in boxes]

    assert [b[1] for b in placed([(0, 0, 10, 10), (5, 5, 15, 15), (5, 5, 15, 15), (50, 0, 60, 10)], 842.0)] == [0, 12, 24, 0]
    rng = random.Random(8)
    for _ in range(200):
        boxes = [(x := rng.randint(0, 60), y := rng.randint(0, 200), x + rng.randint(1, 40), y + rng.randint(1, 30)) for _ in range(rng.randint(1, 25))]
        assert placed(boxes, 842.0) == [tuple(map(float, b)) for b in pushed_down(boxes, 842.0)]


def test_columns_of_a_page():
    from formweave.operators.layout import split_columns

    rows = [(60, y, 200, y + 10) for y in range(100, 200, 20)] + [(400, y, 500, y + 10) for y in range(100, 200, 20)]
    assert split_columns(rows, 0.0, 595.0) == [(0.0, 200), (400, 595.0)]
    assert split_columns(rows[:5], 0.0, 595.0) == [(0.0, 595.0)]
