"""The accumulated corpus: which annotation belongs to which field of which form, over all studies.

Tables are keyed by natural keys (``doc_id`` with ``field_id`` or ``annotation_id``).  Facts are
occurrences and stay one row each; the reports below fold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import field_key, normalize

APPROVED, GEOMETRIC, REJECTED = "HUMAN_APPROVED", "GEOMETRIC", "HUMAN_REJECTED"


def trust_rank(trust: Column) -> Column:
    """2 for a reviewer's approval, 0 for a rejection, else 1."""
    return F.when(trust == APPROVED, 2).when(trust == REJECTED, 0).otherwise(1)


def facts(documents: DataFrame, forms: DataFrame, fields: DataFrame, annotations: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link whose field, annotation, form and document exist, rejected links included."""
    f = fields.select("doc_id", "field_id", "page", F.col("text").alias("field_text"), "form_name", F.col("confidence").alias("field_confidence"), normalize(F.col("form_name")).alias("form_key"))
    m = forms.select("doc_id", normalize(F.col("name")).alias("form_key"), F.col("name"), "domain")
    a = annotations.select("doc_id", "annotation_id", F.col("text").alias("annotation_text"), "annot_type", "variable", "value", "qnam")
    linked = links.select("doc_id", "field_id", "annotation_id", "link_score", "trust", "rejected").join(f, ["doc_id", "field_id"]).join(a, ["doc_id", "annotation_id"])
    return (linked.join(m, ["doc_id", "form_key"]).join(documents.select("doc_id", "file_name"), "doc_id")
            .select("doc_id", "file_name", F.col("name").alias("form_name"), "domain", field_key(F.col("form_name"), F.col("field_text")).alias("field_key"), "page", "field_text",
                    normalize(F.col("field_text")).alias("normalized_text"), "annotation_text", "annot_type", "variable", "value", "qnam", "link_score", "trust", "rejected",
                    "field_confidence", F.struct("doc_id", "field_id", "annotation_id").alias("ord")))


def point(rows: DataFrame, **keys) -> DataFrame:
    """The row of a page, annotation or field by its keys; at most one, the first by id or name."""
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == value)
    return rows.limit(1)


def form_named(forms: DataFrame, name: str) -> DataFrame:
    """The forms of that name, however it is spelt."""
    return forms.filter(normalize(F.col("name")) == normalize(F.lit(name)))


def accepted(all_facts: DataFrame) -> DataFrame:
    """The headline relation: accepted links only."""
    return all_facts.filter(~F.col("rejected"))


def rejected_suggestions(all_facts: DataFrame) -> DataFrame:
    """What reviewers turned down."""
    return all_facts.filter(F.col("trust") == REJECTED).select("field_key", "annotation_text", "variable", "file_name")


def field_map(rows: DataFrame) -> DataFrame:
    """Occurrences folded to a row per key and raw spelling; lists are sorted."""
    as_list = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("field_key", "form_name", "field_text").agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("annotation_text").alias("variants"), as_list("annotation_text").alias("annotation_texts"),
        as_list("variable").alias("variables"), F.max("link_score").alias("best_link_score"))


def field_map_of(rows: DataFrame, form: str) -> DataFrame:
    """The folded rows of one form (by its normalised name)."""
    return field_map(rows.filter(F.col("field_key").startswith(form + "|"))).orderBy("field_key")


def disagreements(rows: DataFrame) -> DataFrame:
    """Keys whose occurrences name more than one annotation."""
    return field_map(rows).filter("variants > 1")


def lookup(rows: DataFrame, form_name: str, field_text: str) -> DataFrame:
    """Facts of one key, best link first."""
    return rows.filter(F.col("field_key") == field_key(F.lit(form_name), F.lit(field_text))).orderBy(F.desc("link_score"), "ord")


def best_variable(rows: DataFrame) -> DataFrame:
    """The first named variable of every key, by score and then order."""
    order = Window.partitionBy("field_key").orderBy(F.desc("link_score"), "ord")
    named = rows.filter(F.coalesce("variable", F.lit("")) != "")
    return named.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("field_key", "variable", "link_score")


def stats(documents: DataFrame, forms: DataFrame, fields: DataFrame, annotations: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of the corpus in one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(documents, "documents")
    for df, name in ((forms, "forms"), (fields, "fields"), (annotations, "annotations"), (links.filter(~F.col("rejected")), "links"), (rows.select("field_key").distinct(), "mapped_keys")):
        out = out.crossJoin(one(df, name))  # one row each
    return out


def link_rows(links: DataFrame, fields: DataFrame, annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the placement that is stored with them; links without field or annotation go."""
    f = fields.select("doc_id", "field_id", F.col("bbox").alias("f"))
    a = annotations.select("doc_id", "annotation_id", F.col("bbox").alias("a"))
    p = pages.select("doc_id", "page", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0).alias("w"), F.when(F.col("height") > 0, F.col("height")).otherwise(1.0).alias("h"))
    fb, ab = F.col("f"), F.col("a")
    return (links.drop("relative_label", "offset_x_pct", "offset_y_pct").join(f, ["doc_id", "field_id"]).join(a, ["doc_id", "annotation_id"]).join(p, ["doc_id", "page"], "left")
            .withColumn("relative_label", F.when(F.col("w").isNotNull(), G.relative_label(ab, fb)))
            .withColumn("offset_x_pct", F.bround((ab.x0 - fb.x1) / F.col("w"), 4)).withColumn("offset_y_pct", F.bround((G.cy(ab) - G.cy(fb)) / F.col("h"), 4)).drop("f", "a", "w", "h"))


def replace_by_key(stored: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` without the keys that ``incoming`` brings, and ``incoming``."""
    keys = incoming.select(key).distinct()
    return stored.join(keys, key, "left_anti").unionByName(incoming)


def save_replacing(incoming: DataFrame, path: str, key: str = "doc_id") -> None:
    """Replace the partitions of ``key`` that ``incoming`` has; other partitions stay untouched."""
    incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
