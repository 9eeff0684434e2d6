"""The knowledge base: derived tables of all studies in one folder, and SQL views over them.

Tables are Parquet folders partitioned by document, so a study that comes again replaces its own
partitions and no other.  Keys of forms and fields are stored, which makes the views plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field_key, normalize
from ..operators import corpus
from .scratch import delete, exists

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMA = {
    "documents": "path string, file_name string, page_count int, doc_id string",
    "forms": "name string, form_key string, domain string, pages array<int>, confidence double, source string, doc_id string",
    "fields": f"field_id string, page int, form_name string, form_key string, text string, normalized_text string, field_key string, confidence double, bbox {BOX}, doc_id string",
    "annotations": f"annotation_id string, page int, ord int, text string, annot_type string, variable string, value string, qnam string, bbox {BOX}, text_color array<double>, font_name string, font_size double, doc_id string",
    "links": "page int, field_id string, annotation_id string, link_score double, trust string, rejected boolean, relative_label string, offset_x_pct double, offset_y_pct double, doc_id string",
}
VIEWS = {
    "field_annotations": """
SELECT d.file_name, m.name AS form_name, m.domain, f.field_key, f.page, f.text AS field_text, f.normalized_text, a.text AS annotation_text, a.annot_type, a.variable, a.value, a.qnam,
       l.link_score, l.trust, f.confidence AS field_confidence, l.doc_id, l.field_id, l.annotation_id
FROM {links} l JOIN {fields} f ON f.doc_id = l.doc_id AND f.field_id = l.field_id JOIN {annotations} a ON a.doc_id = l.doc_id AND a.annotation_id = l.annotation_id
JOIN {forms} m ON m.doc_id = f.doc_id AND m.form_key = f.form_key JOIN {documents} d ON d.doc_id = l.doc_id WHERE NOT l.rejected""",
    "rejected_suggestions": """
SELECT f.field_key, a.text AS annotation_text, a.variable, d.file_name
FROM {links} l JOIN {fields} f ON f.doc_id = l.doc_id AND f.field_id = l.field_id JOIN {annotations} a ON a.doc_id = l.doc_id AND a.annotation_id = l.annotation_id
JOIN {documents} d ON d.doc_id = l.doc_id WHERE l.trust = 'HUMAN_REJECTED'""",
    "field_map": """
SELECT field_key, form_name, field_text, count(*) AS occurrences, count(DISTINCT annotation_text) AS variants, array_join(sort_array(collect_set(annotation_text)), ',') AS annotation_texts,
       array_join(sort_array(collect_set(variable)), ',') AS variables, max(link_score) AS best_link_score
FROM {field_annotations} GROUP BY field_key, form_name, field_text""",
}


def stored_tables(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an analysis in the shape that is stored: keys added, orphans left out.

    Fields on pages that no form claims go, and so do links whose field or annotation is not there.
    """
    forms = found["forms"].withColumn("form_key", normalize(F.col("name")))
    fields = found["fields"].withColumn("form_key", normalize(F.col("form_name"))).withColumn("normalized_text", normalize(F.col("text"))).withColumn("field_key", field_key(F.col("form_name"), F.col("text")))
    fields = fields.join(forms.select("doc_id", "form_key"), ["doc_id", "form_key"], "left_semi")
    links = corpus.link_rows(found["links"].withColumns({c: F.lit(None) for c in ("relative_label", "offset_x_pct", "offset_y_pct")}), fields, found["annotations"], found["pages"])
    tables = {"documents": found["documents"], "forms": forms, "fields": fields, "annotations": found["annotations"], "links": links}
    return {name: _shaped(df, SCHEMA[name]) for name, df in tables.items()}


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    kinds = dict(c.split(" ", 1) for c in schema.split(", "))
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))


def view_frames(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    """The views over tables of that shape."""
    out = dict(tables)
    for name, query in VIEWS.items():
        out[name] = spark.sql(query, **out)
    return {name: out[name] for name in VIEWS}


class KnowledgeBase:
    """Tables, views and questions of one folder; usable in a ``with`` block.

    A folder without tables is given empty ones.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in SCHEMA.items():
            if not exists(spark, f"{self.folder}/{name}"):
                spark.createDataFrame([], schema).write.partitionBy("doc_id").parquet(f"{self.folder}/{name}")

    def __enter__(self) -> KnowledgeBase:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing stays open: every question reads the files."""

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA[name]).parquet(f"{self.folder}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SCHEMA}

    def view(self, name: str) -> DataFrame:
        return view_frames(self.tables(), self.spark)[name]

    def save(self, found: dict[str, DataFrame], replace: bool = True) -> None:
        """Store the documents of an analysis; those with a stored path replace it, or raise."""
        tables = stored_tables(found)
        paths = tables["documents"].select("path").distinct()
        old = [r.doc_id for r in self.table("documents").join(paths, "path", "left_semi").select("doc_id").distinct().collect()]  # documents that come again
        if old and not replace:
            raise ValueError(f"already stored: {', '.join(map(str, sorted(old)[:5]))}")
        for name, df in tables.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{self.folder}/{name}")
        new = {r.doc_id for r in tables["documents"].select("doc_id").distinct().collect()}
        for doc_id in set(old) - new:
            for name in SCHEMA:
                delete(self.spark, f"{self.folder}/{name}/doc_id={doc_id}")

    def facts(self) -> DataFrame:
        t = self.tables()
        return corpus.facts(t["documents"], t["forms"], t["fields"], t["annotations"], t["links"])

    def forms(self) -> DataFrame:
        """Every form of every study, by name."""
        return self.table("forms").select("name", "domain", "pages", "confidence").orderBy("name")

    def lookup(self, form_name: str, field_text: str) -> DataFrame:
        return corpus.lookup(corpus.accepted(self.facts()), form_name, field_text)

    def variable_for(self, form_name: str, field_text: str) -> str | None:
        """The first named variable of a key."""
        named = self.lookup(form_name, field_text).filter(F.coalesce("variable", F.lit("")) != "").first()
        return named.variable if named else None

    def field_map(self, form_name: str | None = None) -> DataFrame:
        rows = self.view("field_map")
        if form_name:
            rows = rows.filter(F.col("field_key").startswith(F.concat(normalize(F.lit(form_name)), F.lit("|"))))
        return rows.orderBy("field_key")

    def disagreements(self) -> DataFrame:
        return self.view("field_map").filter("variants > 1").orderBy("field_key")

    def stats(self) -> DataFrame:
        t = self.tables()
        return corpus.stats(t["documents"], t["forms"], t["fields"], t["annotations"], t["links"], self.view("field_annotations"))
