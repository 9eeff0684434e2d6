"""Driver tables as the engine's inputs: facts, lines, boxes, markup strings and worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field_key, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_domain(key):
    """25 two-letter codes, one per nation."""
    return F.concat(F.chr(F.lit(65) + F.expr("n_nationkey div 5")), F.chr(F.lit(75) + key % 5))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts: suppliers are studies, nations forms, part names labels."""
    t = lambda n: table(spark, sf_dir, n)
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    domain = nation_domain(F.col("n_nationkey"))
    variable = F.when(F.col("l_partkey") % 97 == 0, F.concat("domain", "p_type")).when(first == "small", F.upper(second)).otherwise(F.concat(F.col("domain"), F.upper(second)))
    # nation and supplier are small tables: the planner broadcasts them by size
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = joined.withColumn("domain", domain).withColumn("variable", variable)
    trust = F.when(F.col("l_returnflag") == "A", "HUMAN_APPROVED").when(F.col("l_returnflag") == "R", "HUMAN_REJECTED").otherwise("GEOMETRIC")
    return rows.select(
        F.col("s_name").alias("file_name"), F.col("n_name").alias("form_name"), "domain", field_key(F.col("n_name"), F.col("p_name"), fold=False).alias("field_key"), F.col("l_linenumber").alias("page"),
        F.col("p_name").alias("field_text"), normalize(F.col("p_name"), fold=False).alias("normalized_text"), F.col("variable").alias("annotation_text"), F.lit("VARIABLE").alias("annot_type"), "variable",
        F.bround(1 - F.col("l_discount"), 2).alias("link_score"), trust.alias("trust"), (F.col("l_returnflag") == "R").alias("rejected"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"),
        F.col("p_brand").alias("font_name"), (F.col("p_size") % 7 + 6).cast("double").alias("font_size"), F.col("p_type").alias("text_color"), F.col("l_shipdate").alias("seen_at"), F.bround(F.col("l_tax"), 4).alias("offset_x_pct"),
        F.bround(F.col("l_discount") - F.col("l_tax"), 4).alias("offset_y_pct"), F.element_at(F.array(*map(F.lit, ("right_of_field", "below_field", "right_of_field", "left_of_field", "right_of_field"))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("relative_label"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of document texts with boxes made from their order and length.

    Every seventh line stands lower, every fifth is bold, long texts are in the right column.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    size = F.when(F.col("ord") % 11 == 0, 12.0).otherwise(10.0)
    x0 = F.when(F.col("ord") % 3 == 2, 300.0).otherwise(60.0)
    y0 = 40.0 + 12.0 * F.col("ord") + 9.0 * F.floor(F.col("ord") / 7)
    return docs.filter(F.trim("text") != "").select(
        F.lit("d").alias("doc"), "doc_id", F.col("doc_id").alias("page"), "ord", F.col("text"), size.alias("size"), (F.col("ord") % 5 == 0).alias("bold"), F.floor(F.col("ord") / 2).cast("int").alias("block_no"),
        F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(F.lit(220.0), 5.0 * F.length("text"))).cast("double").alias("x1"), (y0 + 10.0).cast("double").alias("y1")).alias("bbox"),
        F.lit(False).alias("from_annotation"))
