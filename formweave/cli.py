"""Command line: analyse stored extracts, keep a knowledge base and templates, pre-fill a blank form, and
validate, place and learn from a returned worksheet."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, placement, prefill, review, staging, style, template
from .plans.analyze import analyze_documents, summary
from .sources import extracted, workbook
from .sources.knowledge import KnowledgeBase, stored_tables
from .sources.scratch import scratch_dir

SHOWN_ERRORS = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="formweave")
    p.add_argument("tables", help="folder of extracted tables")
    p.add_argument("--out", help="folder for the derived tables")
    p.add_argument("--json", help="folder for one JSON object per document; beyond 256 pages it continues in further ones")
    p.add_argument("--db", help="knowledge base to store the documents in")
    p.add_argument("--template", help="folder to save the documents' templates in")
    p.add_argument("--apply-template", help="folder of saved templates to hold the documents against")
    p.add_argument("--corpus", help="knowledge base of earlier studies")
    p.add_argument("--staging", help="workbook to write for the first document")
    p.add_argument("--import-staging", help="returned workbook to validate")
    p.add_argument("--write-plan", help="with --import-staging: folder for the placements of approved rows")
    p.add_argument("--learn", action="store_true", help="with --import-staging: store the reviewed rows in --corpus")
    p.add_argument("--quiet", action="store_true", help="print nothing but errors")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit status 1 if a worksheet has errors."""
    options = parser()
    args = options.parse_args(argv)
    if args.learn and not (args.corpus and args.import_staging):
        options.error("--learn needs --import-staging, and --corpus for where to store what is learned")
    if args.write_plan and not args.import_staging:
        options.error("--write-plan needs --import-staging")
    spark = SparkSession.builder.getOrCreate()

    def store(df: DataFrame, name: str) -> DataFrame:
        at = scratch_dir(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    say = (lambda *_, **__: None) if args.quiet else print
    found = analyze_documents(extracted.read_tables(spark, args.tables), store)
    if args.out:
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    if args.json:
        extracted.dump_json(found, args.json)
    if args.db:
        with KnowledgeBase(spark, args.db) as kb:
            kb.save(found)
            say(json.dumps(kb.stats().first().asDict()))
    if args.template:
        entries = template.merge_by_key(template.field_entries(found["fields"], found["forms"], found["pages"], found["links"], found["annotations"]))
        template.save_templates(template.build_template(found["documents"], entries, found["forms"]), args.template)
    if args.apply_template:
        matches = template.apply_template(template.entries_of(template.load_templates(spark, args.apply_template)), found["fields"], found["forms"], found["pages"])
        say(json.dumps({r.method: r.n for r in template.summary(matches).collect()}))
    say(json.dumps({r.table: r.rows for r in summary(found).collect()}))
    rows, rejected, forms, house, domains = _history(spark, args.corpus, found)
    if args.staging:
        own = found["forms"].select("doc_id", F.col("name").alias("form_name"), "domain")
        filled = prefill.prefill(found["fields"].join(own, ["doc_id", "form_name"], "left"), rows, rejected, forms)
        sheet = staging.build_staging(found["fields"], filled, house, found["pages"])
        workbook.write_sheets(args.staging, staging.sheets(sheet, house, found["forms"], domains), {"Annotations": {"status": staging.STATUSES}})
        say(json.dumps({r.status: r.rows for r in staging.summary(sheet).collect()}))
    return _import(spark, args, found, domains, store, say) if args.import_staging else 0


def _history(spark: SparkSession, path: str | None, found: dict[str, DataFrame]):
    """Accepted facts, rejections, forms, house style and form domains of a knowledge base; all empty without one."""
    if path:
        kb = KnowledgeBase(spark, path)
        tables, rows = kb.tables(), kb.facts()
    else:
        tables = {name: df.limit(0) for name, df in stored_tables(found).items()}
        rows = corpus.facts(*(tables[n] for n in ("documents", "forms", "fields", "annotations", "links")))
    accepted = corpus.accepted(rows)
    return accepted, corpus.rejected_suggestions(rows), tables["forms"], style.style_of_corpus(tables["annotations"], tables["links"]), prefill.form_domains(accepted, tables["forms"])


def _import(spark: SparkSession, args, found: dict[str, DataFrame], domains: DataFrame, store, say) -> int:
    sheets = workbook.read_workbook(args.import_staging)
    values, formulas = workbook.sheet_frames(spark, sheets.get("Annotations", []), staging.COLUMNS)
    geometry, _ = workbook.sheet_frames(spark, sheets.get("Geometry", []), staging.GEOMETRY)
    own = found["forms"].filter("domain <> ''").groupBy(F.col("normalized_name").alias("form_key")).agg(F.min("domain").alias("own"))
    known = own.join(domains.select("form_key", "domain"), "form_key", "full").select("form_key", F.coalesce("own", "domain").alias("domain"))
    rows = store(review.validate(values, geometry, found["fields"], known, formulas), "imported")
    absent = review.missing_sheets(spark.createDataFrame([(n,) for n in sheets] or [("",)], "sheet string"))
    issues = store(review.all_issues(rows, review.missing_rows(found["fields"], rows), absent), "issues")
    say(json.dumps(review.report(rows, issues).first().asDict()))
    for r in issues.filter("severity = 'ERROR'").orderBy("row_id", "column", "code").limit(SHOWN_ERRORS).collect():
        print(f"{r.row_id} {r.column} {r.code}: {r.message}", file=sys.stderr)
    if args.write_plan:
        pages = found["documents"].agg(F.max("page_count")).first()[0] or 0
        placed, skipped = placement.write_plan(rows, pages)
        placed.write.mode("overwrite").parquet(f"{args.write_plan}/placements")
        skipped.write.mode("overwrite").parquet(f"{args.write_plan}/skipped")
    if args.learn:
        name = f"{found['documents'].first().file_name.rsplit('.', 1)[0]} reviewed"
        learned = review.learned_rows(rows, found["fields"], found["pages"], name)
        source = found["documents"].limit(1).select(F.lit(name).alias("doc_id"), F.lit(name).alias("path"), F.lit(name).alias("file_name"), "page_count")
        forms = learned["fields"].groupBy("doc_id", F.col("form_name").alias("name")).agg(F.array_sort(F.collect_set("page")).alias("pages"))
        forms = forms.join(known.select("form_key", "domain"), review.normalize(F.col("name")) == F.col("form_key"), "left").select("doc_id", "name", F.coalesce("domain", F.lit("")).alias("domain"), "pages", F.lit(1.0).alias("confidence"), F.lit("REVIEWED").alias("source"))
        pages = found["pages"].withColumn("doc_id", F.lit(name))
        KnowledgeBase(spark, args.corpus).save({**learned, "documents": source, "forms": forms, "pages": pages})
    return int(issues.filter("severity = 'ERROR'").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
