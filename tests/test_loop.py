"""The command line's loop over stored studies, the knowledge base, and templates."""

import pytest
from pyspark.errors import PySparkException

from formweave import cli
from formweave.operators import corpus, layout, prefill, staging, template
from formweave.sources import extracted, workbook
from formweave.sources.knowledge import KnowledgeBase, view_frames
from tests import forms_fixture


def stored(spark, folder, doc_id, pages):
    found = forms_fixture.tables(spark, doc_id, pages)
    for name, schema in extracted.TABLES.items():
        kinds = dict(c.split(" ", 1) for c in extracted._columns(schema))
        from pyspark.sql import functions as F

        df = found.get(name, spark.createDataFrame([], schema))
        df = df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)


def test_loop_over_studies(spark, tmp_path, capsys):
    first = stored(spark, tmp_path / "one", "study1", forms_fixture.STUDY_1)
    kb, saved = str(tmp_path / "kb"), str(tmp_path / "templates")
    assert cli.main([first, "--db", kb, "--template", saved]) == 0
    assert '"mapped_keys"' in capsys.readouterr().out
    blank = stored(spark, tmp_path / "two", "blank", forms_fixture.without_markup(forms_fixture.STUDY_1))
    sheet = str(tmp_path / "sheet.xlsx")
    assert cli.main([blank, "--corpus", kb, "--staging", sheet, "--apply-template", saved]) == 0
    said = capsys.readouterr().out
    assert '"EXACT_KEY": 13' in said and '"TEXT_ONLY": 1' in said and '"AUTO": 9' in said

    rows = workbook.read_workbook(sheet)
    back = [{c: v[0] for c, v in r.items()} for r in rows["Annotations"]]
    for r in back:
        r["status"], r["color_rgb"], r["reviewer_note"] = ("APPROVED", "#D91A1A", "") if r["status"] == "AUTO" else ("REJECTED", "", "not in this study")
    geometry = [{c: v[0] for c, v in r.items()} for r in rows["Geometry"]]
    as_rows = lambda rows, columns: (columns, [tuple(r.get(c) for c in columns) for r in rows])
    workbook.write_workbook(sheet, {"Annotations": as_rows(back, staging.COLUMNS), "Geometry": as_rows(geometry, staging.GEOMETRY)})
    plan = str(tmp_path / "plan")
    assert cli.main([blank, "--import-staging", sheet, "--corpus", kb, "--write-plan", plan, "--learn"]) == 0
    assert '"approved": 9' in capsys.readouterr().out
    assert spark.read.parquet(f"{plan}/placements").count() == 9 and spark.read.parquet(f"{plan}/skipped").count() == 5
    with KnowledgeBase(spark, kb) as base:
        assert {r.doc_id for r in base.table("documents").collect()} == {"study1", "blank reviewed"}
        assert base.facts().filter("trust = 'HUMAN_APPROVED'").count() == 9
        assert base.variable_for("Medical history", "condition:") == "MHTERM" and base.variable_for("none", "none") is None

    damaged = [dict(r, status="DONE") for r in back]
    workbook.write_workbook(sheet, {"Annotations": as_rows(damaged, staging.COLUMNS)})
    assert cli.main([blank, "--import-staging", sheet, "--quiet"]) == 1
    said = capsys.readouterr()
    assert not said.out.strip() and "BAD_STATUS" in said.err and "MISSING_SHEET" in said.err
    with pytest.raises(SystemExit):
        cli.main([blank, "--learn"])


def test_knowledge_base_replaces_documents(spark, study, second, tmp_path):
    with KnowledgeBase(spark, str(tmp_path / "kb")) as kb:
        assert kb.forms().count() == 0 and kb.stats().first().links == 0
        kb.save(study)
        kb.save(second)
        with pytest.raises(ValueError):
            kb.save(study, replace=False)
        before = kb.stats().first()
        kb.save(study)
        assert kb.stats().first() == before and before.documents == 2 and before.links == 12
        assert [r.name for r in kb.forms().collect()] == ["Adverse Events", "Demographics", "Disposition", "Eligibility Criteria", "Medical History"]
        assert kb.field_map("Medical History").count() == kb.field_map().filter("field_key LIKE 'medical history|%'").count() > 0
        assert kb.disagreements().count() == 0
        views = view_frames(kb.tables(), spark)
        assert views["field_annotations"].count() == corpus.accepted(kb.facts()).count() == 12


def test_index_without_a_knowledge_base(study):
    rows = prefill.index_from_documents(study)
    assert {r.trust for r in rows.select("trust").collect()} == {"GEOMETRIC"} and rows.count() == 9
    assert {r.confidence for r in prefill.exact_winners(rows).collect()} == {0.95}


def test_templates_of_another_version_are_refused(spark, study, tmp_path):
    from pyspark.sql import functions as F

    entries = template.merge_by_key(template.field_entries(study["fields"], study["forms"], study["pages"], study["links"], study["annotations"]))
    built = template.build_template(study["documents"], entries, study["forms"])
    template.save_templates(built, str(tmp_path / "t"))
    loaded = template.load_templates(spark, str(tmp_path / "t"))
    assert template.entries_of(loaded).count() == entries.count() and loaded.first().forms[0].fields[0].annotations is not None
    template.save_templates(built.withColumn("template_version", F.lit(9)), str(tmp_path / "u"))
    with pytest.raises(PySparkException):
        template.load_templates(spark, str(tmp_path / "u")).collect()


def test_points_and_page_text(study):
    assert corpus.point(study["pages"], page=2).count() == 1 and corpus.point(study["pages"], page=9).count() == 0
    assert corpus.form_named(study["forms"], " medical  HISTORY").first().name == "Medical History"
    text = {r.page: r.text for r in layout.page_text(study["lines"]).collect()}
    assert text[2].split("\n")[1] == "Form: Medical History" and "MHTERM" not in text[2]
    assert layout.groups_of_role(study["groups"], "SECTION_HEADER").count() > 0


def test_files_that_cannot_be_decoded(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        extracted.open_files(spark, str(tmp_path / "missing"))
    (tmp_path / "plain.pdf").write_bytes(b"%PDF-1.7 trailer")
    assert bytes(extracted.open_files(spark, str(tmp_path / "plain.pdf")).first().content) == b"%PDF-1.7 trailer"
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.7 trailer << /Encrypt 5 0 R >>")
    with pytest.raises(PySparkException, match="is encrypted"):
        extracted.open_files(spark, str(tmp_path / "locked.pdf")).collect()
