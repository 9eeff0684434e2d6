"""Documents as JSON objects: long ones in several, whole texts."""

import json
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from formweave.sources import extracted


def objects(folder):
    return [json.loads(line) for path in Path(folder).glob("part-*.json") for line in path.read_text().splitlines()]


def test_long_documents_go_on_in_further_objects(spark, tmp_path):
    """A short document is one object; no object has more pages than OBJECT_PAGES, and no row is lost."""
    n, at = 3 * extracted.OBJECT_PAGES, str(tmp_path / "json")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = {"documents": table([("long", "l.pdf"), ("short", "s.pdf"), ("bare", "b.pdf")], "doc_id string, file_name string"),
             "forms": table([("long", "a", 1), ("long", "b", n), ("short", "a", 1)], "doc_id string, name string, first_page int"),
             "fields": table([("long", p, f"f{p}") for p in range(1, n + 1)] + [("short", 1, "f1"), ("short", 2, "f2")], "doc_id string, page int, field_id string"),
             "links": table([("long", n, "f1", True), ("short", 2, "f2", False)], "doc_id string, page int, field_id string, rejected boolean")}
    extracted.dump_json(found, at)
    got = objects(at)
    assert Counter(o["doc_id"] for o in got) == {"long": 4, "short": 1, "bare": 1}
    assert max(len(o["fields"]) for o in got) == extracted.OBJECT_PAGES
    assert sorted((o["doc_id"], f["page"], f["field_id"]) for o in got for f in o["fields"]) == sorted(map(tuple, found["fields"].collect()))
    assert {o["doc_id"]: o["file_name"] for o in got if o["part"] == 0} == {"long": "l.pdf", "short": "s.pdf", "bare": "b.pdf"}
    assert [(len(o["forms"]), len(o["links"])) for o in sorted(got, key=lambda o: o["part"]) if o["doc_id"] == "long"] == [(1, 0), (0, 0), (0, 0), (1, 1)]
    back = extracted.load_json(spark, at, found)
    assert sorted((r.doc_id, r.part, len(r.fields), [x.rejected for x in r.links]) for r in back.collect()) == sorted((o["doc_id"], o["part"], len(o["fields"]), [x["rejected"] for x in o["links"]]) for o in got)


def test_study_of_files_has_whole_texts(spark, tmp_path):
    """All lines are in the dump, also those after the 20th, and a line whose first word has no letter."""
    import duckdb

    from formweave.plans import oracle_study, study_queries

    texts = {0: "\n".join(f"- line {i}" for i in range(45)), 1: "short", 2: None, 3: "\n" * 30 + "late\n--\n ™ \n é\n\n\n\u00a0\u3000", 10: "x\n" * 25}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, study_queries.json_files(spark, str(tmp_path)).collect()))
    assert got == [("s0", "s0.v1.pdf", 1, 23, 8, 8), ("s1", "s1.v1.pdf", 1, 1, 1, 0), ("s2", "s2.v1.pdf", 2, 13, 5, 5), ("s3", "s3.v1.pdf", 1, 1, 1, 0)]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(db.sql(oracle_study.SQL["json_files"]).fetchall()) == got
    fields = study_queries._study(spark, str(tmp_path), whole=True)["fields"]
    assert {r.text for r in fields.filter("page = 0").collect()} == {f"- line {i}" for i in range(0, 45, 2)}


def test_an_analysed_study_is_one_object(spark, study, tmp_path):
    extracted.dump_json(study, str(tmp_path / "json"))
    (only,) = objects(tmp_path / "json")
    assert (len(only["forms"]), len(only["fields"]), len(only["links"])) == (4, 14, 9)
    (back,) = extracted.load_json(spark, str(tmp_path / "json"), study).collect()
    assert sorted(f.field_id for f in back.fields) == sorted(f["field_id"] for f in only["fields"])
