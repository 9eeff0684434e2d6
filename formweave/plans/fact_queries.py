"""Queries over facts: corpus reports, pre-fill tiers and house style."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import token_part
from ..operators import corpus, prefill, style
from ..sources.scratch import scratch_dir
from .adapters import facts


def _acc(spark, sf):
    return corpus.accepted(facts(spark, sf))


def _fields(spark, sf):
    """Every key of the facts as a field of a blank form."""
    f = facts(spark, sf)
    return f.select(F.lit("blank").alias("doc_id"), F.col("field_key").alias("field_id"), "form_name", F.col("field_text").alias("text"), "domain").distinct()


def _keys(spark, sf):
    return facts(spark, sf).select(F.substring_index("field_key", "|", 1).alias("form_key"), "normalized_text", "domain").distinct()


def _tiers(spark, sf, with_fuzzy=True):
    """The tiers read the facts several times: their columns are stored first."""
    at = scratch_dir(spark, "facts")
    facts(spark, sf).select("file_name", "form_name", "domain", "field_key", "field_text", "normalized_text", "annotation_text", "annot_type", "variable", "link_score", "trust", "rejected", "ord").write.parquet(at)
    f = spark.read.parquet(at)
    blank = f.select(F.lit("blank").alias("doc_id"), F.col("field_key").alias("field_id"), "form_name", F.col("field_text").alias("text"), "domain").distinct()
    return prefill.prefill(blank, corpus.accepted(f), corpus.rejected_suggestions(f), with_fuzzy=with_fuzzy)


def kb_stats(spark, sf):
    f = facts(spark, sf)
    acc = corpus.accepted(f)
    form = F.substring_index("field_key", "|", 1)
    return corpus.stats(f.select("file_name").distinct(), f.select(form).distinct(), f.select("field_key").distinct(), f, f, acc)


def lookup_key(spark, sf):
    acc = _acc(spark, sf)
    first = acc.agg(F.min("field_key").alias("_k"))  # one row
    return acc.join(F.broadcast(first), acc.field_key == F.col("_k")).select("file_name", "variable", "link_score", "ord")


def house(spark, sf):
    kind = F.when(F.col("page") <= 2, "VARIABLE").when(F.col("page") <= 4, "SUPP_QUALIFIER").otherwise("NOTE")
    rows = _acc(spark, sf).withColumn("annot_type", kind)
    return style.house_style(rows, rows).drop("placement_samples")


def fuzzy_tokens(spark, sf):
    labels = _acc(spark, sf).select(F.substring_index("field_key", "|", 1).alias("form_key"), "normalized_text").distinct()
    pairs = labels.withColumnRenamed("normalized_text", "a").join(labels.withColumnRenamed("normalized_text", "b"), "form_key")
    return pairs.withColumn("token_part", F.round(token_part(F.col("a"), F.col("b")), 6))


def queries():
    key = ["form_key", "normalized_text", "confidence", "variable", "source"]
    tiers = ["form_key", "normalized_text", "best.tier", "best.variable", "best.confidence", "status"]
    return {
        "rejected_suggestions": lambda s, d: corpus.rejected_suggestions(facts(s, d)),
        "kb_stats": kb_stats,
        "field_map": lambda s, d: corpus.field_map(_acc(s, d)),
        "disagreements": lambda s, d: corpus.disagreements(_acc(s, d)).select("field_key", "occurrences", "variants", "variables"),
        "field_map_of_form": lambda s, d: corpus.field_map_of(_acc(s, d), "nation_7").select("field_key", "occurrences", "best_link_score"),
        "lookup_best": lambda s, d: corpus.best_variable(_acc(s, d)),
        "lookup_key": lookup_key,
        "exact_key_winner": lambda s, d: prefill.exact_winners(_acc(s, d)).select(*key),
        "consensus": lambda s, d: prefill.consensus(_acc(s, d), _keys(s, d)).select(*key),
        "suffixes": lambda s, d: prefill.suffixes(_acc(s, d)).withColumn("domains", F.array_join("domains", ",")),
        "domain_pattern": lambda s, d: prefill.domain_pattern(_acc(s, d), _keys(s, d)).select(*key),
        "form_domain_mode": lambda s, d: prefill.form_domains(_acc(s, d)),
        "aliases": lambda s, d: prefill.aliases(_acc(s, d)).withColumn("labels", F.array_join("labels", ",")),
        "rejection_suppression": lambda s, d: prefill.suppress_rejected(prefill.exact_winners(_acc(s, d)), corpus.rejected_suggestions(facts(s, d))).select("form_key", "normalized_text", "variable", "confidence"),
        "prefill_all_tiers": lambda s, d: _tiers(s, d).select(*tiers),
        "prefill_all_summary": lambda s, d: prefill.summary(_tiers(s, d)),
        # as their SQL: without the fuzzy tier, whose sequence ratio DuckDB lacks
        "prefill_tiers": lambda s, d: _tiers(s, d, with_fuzzy=False).select(*tiers),
        "prefill_summary": lambda s, d: prefill.summary(_tiers(s, d, with_fuzzy=False)),
        "fuzzy_tokens": fuzzy_tokens,
        "fuzzy_same_form": lambda s, d: prefill.fuzzy(_acc(s, d), _keys(s, d)).select(*key),
        "house_style": house,
    }
