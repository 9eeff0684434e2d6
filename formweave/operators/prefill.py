"""Answering the fields of a blank form from the corpus, tier by tier.

Each tier is a join against a small table derived from the facts; the best candidate of a field is
the most confident, ties in the order of the tiers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import WEIGHTS, similarity, stems
from ..functions.text import normalize
from .corpus import APPROVED, GEOMETRIC, accepted, facts, trust_rank

EXACT, CONSENSUS, PATTERN, FUZZY, NONE = "EXACT_KEY", "CROSS_FORM_CONSENSUS", "DOMAIN_PATTERN", "FUZZY_SAME_FORM", "NEEDS_MAPPING"
_TIERS = [EXACT, CONSENSUS, PATTERN, FUZZY, NONE]
_CANDIDATE = ["tier", "confidence", "variable", "annotation_text", "annot_type", "source", "evidence"]


@dataclass(frozen=True)
class Tunables:
    """Thresholds; the defaults are tuned to small synthetic forms."""
    exact: float = 0.95
    approved: float = 1.0
    auto: float = 0.9
    review: float = 0.5
    fuzzy_floor: float = 0.6
    consensus_forms: int = 2
    pattern_domains: int = 2


DEFAULTS = Tunables()


def _form(rows: DataFrame) -> DataFrame:
    return rows.withColumn("form_key", F.substring_index("field_key", "|", 1))


def _source():
    return F.concat_ws(" · ", "file_name", "form_name", "field_text")


def exact_winners(rows: DataFrame, t: Tunables = DEFAULTS, first_row_parity: bool = False) -> DataFrame:
    """The candidate of every (form, text) key: highest trust, then score, then order.

    ``first_row_parity`` keeps the older rule for equal trust: the first row stays unless a later
    score beats the confidence of an exact hit.
    """
    rank = trust_rank(F.col("trust"))
    score = F.when(F.col("link_score") > F.when(F.col("trust") == APPROVED, t.approved).otherwise(t.exact), 1).otherwise(0) if first_row_parity else F.col("link_score")
    order = Window.partitionBy("form_key", "normalized_text").orderBy(F.desc(rank), F.desc(score), "ord")
    approved = F.col("trust") == APPROVED
    return (_form(rows).withColumn("_k", F.row_number().over(order)).filter("_k = 1")
            .select("form_key", "normalized_text", F.lit(EXACT).alias("tier"), F.when(approved, t.approved).otherwise(t.exact).alias("confidence"), F.coalesce("variable", F.lit("")).alias("variable"),
                    "annotation_text", "annot_type", _source().alias("source"),
                    F.array(F.concat(F.when(approved, "a reviewer approved it in ").otherwise("same form and label in "), "file_name")).alias("evidence")))


def consensus(rows: DataFrame, fields: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """Labels as other forms use them: a candidate if all agree, a zero with the finding if not.

    Facts are folded per label and form and then per label, with what is needed to leave a form's own
    use out again: which form is the only one with a variable, and the two forms that came first.
    So a label that many forms share costs a row per form, not a pair of forms.
    """
    named = _form(rows).filter(F.coalesce("variable", F.lit("")) != "")
    first = F.min(F.struct("ord", "variable", "annotation_text", "annot_type", _source().alias("source")))
    by_form = named.groupBy("normalized_text", "form_key").agg(F.collect_set("variable").alias("vars"), F.countDistinct("form_name").alias("names"), first.alias("first"))
    used = by_form.select("normalized_text", "form_key", F.explode("vars").alias("v")).groupBy("normalized_text", "v").agg(F.count(F.lit(1)).alias("n"), F.min("form_key").alias("sole"))
    used = used.groupBy("normalized_text").agg(F.array_sort(F.collect_list(F.struct("v", "n", "sole"))).alias("used"))
    early = by_form.withColumn("k", F.row_number().over(Window.partitionBy("normalized_text").orderBy("first"))).filter("k <= 2")
    early = early.groupBy("normalized_text").agg(F.array_sort(F.collect_list(F.struct("k", F.col("form_key").alias("of"), "first"))).alias("early"))
    total = by_form.groupBy("normalized_text").agg(F.sum("names").alias("total"))
    own = by_form.select("normalized_text", "form_key", F.col("names").alias("own"))
    keys = fields.select("form_key", "normalized_text").distinct()
    joined = keys.join(used.join(early, "normalized_text").join(total, "normalized_text"), "normalized_text").join(own, ["normalized_text", "form_key"], "left")
    me = F.col("form_key")
    merged = joined.select("form_key", "normalized_text", F.transform(F.filter("used", lambda x: (x.n > 1) | (x.sole != me)), lambda x: x.v).alias("vars"), (F.col("total") - F.coalesce("own", F.lit(0))).alias("forms"),
                           F.get(F.filter("early", lambda x: x.of != me), F.lit(0)).first.alias("first")).filter("forms > 0")
    split = F.size("vars") > 1
    keep = lambda c: F.when(split, F.lit("")).otherwise(F.col(f"first.{c}"))
    says = F.when(split, F.concat(F.lit("other forms give this label ["), F.array_join(F.transform("vars", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "),
                                  F.lit("], so no form speaks for another")))
    says = says.otherwise(F.concat(F.lit(""), F.element_at("vars", 1), F.lit(" in each of the "), F.col("forms").cast("string"), F.lit(" other forms with this label")))
    return (merged.filter(split | (F.col("forms") >= t.consensus_forms))
            .select("form_key", "normalized_text", F.lit(CONSENSUS).alias("tier"), F.when(split, 0.0).otherwise(F.bround(F.least(F.lit(0.85), 0.55 + 0.05 * F.col("forms")), 3)).alias("confidence"),
                    keep("variable").alias("variable"), keep("annotation_text").alias("annotation_text"), keep("annot_type").alias("annot_type"), keep("source").alias("source"), F.array(says).alias("evidence")))


def suffixes(rows: DataFrame) -> DataFrame:
    """Role suffixes per label, with the domains that attest them."""
    domain, variable = F.upper(F.coalesce("domain", F.lit(""))), F.upper(F.coalesce("variable", F.lit("")))
    cut = F.expr("substring(_v, length(_d) + 1)")
    learned = (rows.select("normalized_text", domain.alias("_d"), variable.alias("_v")).filter((F.col("_d") != "") & F.col("_v").startswith(F.col("_d")) & (F.length("_v") > F.length("_d")))
               .withColumn("suffix", cut).filter(F.col("suffix").rlike("^[A-Z][A-Z0-9]{1,6}$")))
    return learned.groupBy("normalized_text", "suffix").agg(F.array_sort(F.collect_set("_d")).alias("domains"))


def domain_pattern(rows: DataFrame, fields: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """The form's domain with the one suffix that a label has in two or more domains."""
    single = suffixes(rows).groupBy("normalized_text").agg(F.count(F.lit(1)).alias("n"), F.first("suffix").alias("suffix"), F.first("domains").alias("domains"))
    single = single.filter((F.col("n") == 1) & (F.size("domains") >= t.pattern_domains))
    keys = fields.filter(F.coalesce("domain", F.lit("")) != "").select("form_key", "normalized_text", "domain").distinct()
    made, count, named = F.concat("domain", "suffix"), F.size("domains"), F.array_join("domains", ", ")
    return (keys.join(single, "normalized_text")
            .select("form_key", "normalized_text", F.lit(PATTERN).alias("tier"), F.bround(F.least(F.lit(0.85), 0.6 + 0.05 * count), 3).alias("confidence"), made.alias("variable"), made.alias("annotation_text"),
                    F.lit("VARIABLE").alias("annot_type"), F.concat(F.lit("convention "), "suffix", F.lit(" in "), named).alias("source"),
                    F.array(F.concat(F.lit("'"), "normalized_text", F.lit("' ends in "), "suffix", F.lit(" in "), count.cast("string"), F.lit(" domains ("), named, F.lit("); here the domain is "), "domain")).alias("evidence")))


def fuzzy(rows: DataFrame, fields: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """The nearest wording within the same form, above the floor.

    Joins on the form over its distinct labels.  Labels without a common stem reach at most the weight
    of the sequence ratio; above that floor only labels that share a stem are compared.
    """
    named = _form(rows).filter(F.coalesce("variable", F.lit("")) != "")
    labels = named.groupBy("form_key", F.col("normalized_text").alias("seen")).agg(F.min(F.struct("ord", "variable", "annotation_text", "annot_type", _source().alias("source"), "field_text")).alias("first"))
    keys = fields.select("form_key", "normalized_text").distinct()
    pairs = keys.join(labels.select("form_key", "seen"), "form_key")
    if t.fuzzy_floor >= WEIGHTS[0]:
        stem = lambda df, c: df.select("form_key", c, F.explode(stems(F.col(c))).alias("stem"))
        pairs = stem(keys, "normalized_text").join(stem(labels, "seen"), ["form_key", "stem"]).select("form_key", "normalized_text", "seen").distinct()
    scored = pairs.withColumn("sim", similarity(F.col("normalized_text"), F.col("seen"))).filter(F.col("sim") > t.fuzzy_floor).join(labels, ["form_key", "seen"])
    order = Window.partitionBy("form_key", "normalized_text").orderBy(F.desc("sim"), "first.ord")
    best = scored.withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    return best.select("form_key", "normalized_text", F.lit(FUZZY).alias("tier"), F.bround(0.5 + 0.35 * (F.col("sim") - t.fuzzy_floor) / (1 - t.fuzzy_floor), 3).alias("confidence"),
                       *(F.col(f"first.{c}").alias(c) for c in ("variable", "annotation_text", "annot_type", "source")),
                       F.array(F.format_string("likeness %.2f to '%s' in this form", F.col("sim"), F.col("first.field_text"))).alias("evidence"))


def form_domains(rows: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """The most frequent domain of every form: a vote per fact and one per row of ``forms``."""
    votes = _form(rows).filter(F.coalesce("domain", F.lit("")) != "").groupBy("form_key", F.upper("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    if forms is not None:
        own = forms.filter(F.coalesce("domain", F.lit("")) != "").groupBy(normalize(F.col("name")).alias("form_key"), F.upper("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
        votes = votes.unionByName(own, allowMissingColumns=True).groupBy("form_key", "domain").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
    order = Window.partitionBy("form_key").orderBy(F.desc("n"), F.asc_nulls_last("ord"), "domain")
    return votes.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("form_key", "domain", F.col("n").alias("votes"))


def aliases(rows: DataFrame) -> DataFrame:
    """All labels that a form has used for a variable."""
    return _form(rows).filter(F.coalesce("variable", F.lit("")) != "").groupBy("form_key", "variable").agg(F.array_sort(F.collect_set("field_text")).alias("labels"))


def suppress_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates that a reviewer turned down for their key get no confidence, and say why."""
    no = rejected.filter(F.coalesce("annotation_text", F.lit("")) != "").select("field_key", "annotation_text").distinct().withColumn("_no", F.lit(True))
    key = F.concat_ws("|", "form_key", "normalized_text")
    joined = candidates.withColumn("field_key", key).join(no, ["field_key", "annotation_text"], "left")
    return (joined.withColumn("confidence", F.when(F.col("_no"), 0.0).otherwise(F.col("confidence")))
            .withColumn("evidence", F.when(F.col("_no"), F.concat("evidence", F.array(F.lit("a reviewer has turned this down before")))).otherwise(F.col("evidence"))).drop("_no", "field_key"))


def status(tier, confidence, t: Tunables = DEFAULTS):
    return F.when((tier == EXACT) & (confidence >= t.auto), "AUTO").when(confidence >= t.review, "NEEDS_REVIEW").otherwise("NEEDS_MAPPING")


def index_from_documents(found: dict[str, DataFrame]) -> DataFrame:
    """Facts of an analysis that is not stored: accepted links, all of them equally trusted.

    Without a knowledge base nobody has reviewed anything, so there are no rejections either.
    """
    rows = facts(found["documents"], found["forms"], found["fields"], found["annotations"], found["links"])
    return accepted(rows).withColumn("trust", F.lit(GEOMETRIC))


def prefill(fields: DataFrame, rows: DataFrame, rejected: DataFrame | None = None, forms: DataFrame | None = None, t: Tunables = DEFAULTS, with_fuzzy: bool = True) -> DataFrame:
    """Best candidate, alternates and aliases for every field.

    ``fields``: ``doc_id``, ``field_id``, ``form_name``, ``text`` and ``domain`` (of its own form,
    may be empty: history then decides).  ``rows``: accepted facts.  Candidates are worked out per
    distinct key and joined to the fields last.
    """
    keyed = fields.withColumn("form_key", normalize(F.col("form_name"))).withColumn("normalized_text", normalize(F.col("text")))
    learned = form_domains(rows, forms).select("form_key", F.col("domain").alias("_learned"))
    keyed = keyed.join(learned, "form_key", "left").withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), "_learned", F.lit(""))).drop("_learned")
    keys = keyed.select("form_key", "normalized_text", "domain").distinct()
    exact = keys.join(exact_winners(rows, t), ["form_key", "normalized_text"]).select("form_key", "normalized_text", "domain", *_CANDIDATE)
    by_key = lambda c: keys.join(c, ["form_key", "normalized_text"]).select("form_key", "normalized_text", "domain", *_CANDIDATE)
    pattern = domain_pattern(rows, keys, t).withColumn("domain", F.regexp_extract(F.element_at("evidence", 1), "here the domain is (.*)$", 1)).select("form_key", "normalized_text", "domain", *_CANDIDATE)
    found = exact.unionByName(by_key(consensus(rows, keys, t))).unionByName(pattern)
    if with_fuzzy:
        found = found.unionByName(by_key(fuzzy(rows, keys, t)))
    if rejected is not None:
        found = suppress_rejected(found, rejected)
    rank = F.array_position(F.array(*map(F.lit, _TIERS)), F.col("tier"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), rank.alias("rank"), *_CANDIDATE)))
    grouped = found.groupBy("form_key", "normalized_text", "domain").agg(ordered.alias("all"))
    nothing = F.struct(F.lit(0.0).alias("order"), F.lit(len(_TIERS)).cast("long").alias("rank"), F.lit(NONE).alias("tier"), F.lit(0.0).alias("confidence"), F.lit("").alias("variable"), F.lit("").alias("annotation_text"),
                       F.lit("").alias("annot_type"), F.lit("").alias("source"), F.array(F.lit("nothing like it in the corpus")).alias("evidence"))
    out = (keyed.join(grouped, ["form_key", "normalized_text", "domain"], "left").withColumn("best", F.coalesce(F.element_at("all", 1), nothing))
           .withColumn("alternates", F.coalesce(F.slice("all", F.lit(2), F.greatest(F.size("all"), F.lit(1))), F.array().cast(grouped.schema["all"].dataType))).withColumn("status", status(F.col("best.tier"), F.col("best.confidence"), t)))
    other = aliases(rows).select("form_key", F.col("variable").alias("_v"), "labels")
    out = out.join(other, (out.form_key == other.form_key) & (out.best.variable == F.col("_v")) & (F.col("_v") != ""), "left").drop(other.form_key).drop("_v")
    lowered = F.filter("labels", lambda x: normalize(x, fold=False) != F.col("normalized_text"))
    return out.withColumn("aliases", F.coalesce(lowered, F.array().cast("array<string>"))).drop("all", "labels")


def summary(filled: DataFrame) -> DataFrame:
    """Fields, rows per status and the rate that history answered."""
    auto = F.count_if(F.col("status") == "AUTO")
    return filled.agg(F.count(F.lit(1)).alias("fields"), auto.alias("auto"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"), F.count_if(F.col("status") == "NEEDS_MAPPING").alias("reaches_agent"),
                      F.bround(auto / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("auto_fill_rate"))
