"""DuckDB SQL for the queries over facts."""

FACTS = r"""
WITH facts AS (
  SELECT s_name AS file_name, n_name AS form_name, domain, lower(regexp_replace(n_name, '[^\p{L}\p{N}_\s]', ' ', 'g')) || '|' || lower(p_name) AS field_key,
         l_linenumber AS page, p_name AS field_text, lower(p_name) AS normalized_text, lower(n_name) AS form_key,
         CASE WHEN l_partkey % 97 = 0 THEN domain || p_type WHEN w1 = 'small' THEN upper(w2) ELSE domain || upper(w2) END AS variable,
         round(1 - l_discount, 2) AS link_score,
         CASE l_returnflag WHEN 'A' THEN 'HUMAN_APPROVED' WHEN 'R' THEN 'HUMAN_REJECTED' ELSE 'GEOMETRIC' END AS trust,
         CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 0 ELSE 1 END AS trust_rank,
         l_returnflag = 'R' AS rejected, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, p_brand AS font_name, (p_size % 7 + 6)::DOUBLE AS font_size, p_type AS text_color,
         round(l_tax, 4) AS offset_x_pct, round(l_discount - l_tax, 4) AS offset_y_pct,
         ['right_of_field', 'below_field', 'right_of_field', 'left_of_field', 'right_of_field'][(l_linenumber % 5 + 1)::INT] AS relative_label
  FROM (SELECT *, chr((65 + n_nationkey // 5)::INT) || chr((75 + n_nationkey % 5)::INT) AS domain, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)),
acc AS (SELECT *, variable AS annotation_text, 'VARIABLE' AS annot_type, file_name || ' · ' || form_name || ' · ' || field_text AS source FROM facts WHERE NOT rejected),
no AS (SELECT DISTINCT field_key, variable AS annotation_text FROM facts WHERE rejected)
"""
EXACT = """
, exact AS (
  SELECT form_key, normalized_text, 'EXACT_KEY' AS tier, CASE WHEN trust_rank = 2 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, variable, source
  FROM acc QUALIFY row_number() OVER (PARTITION BY form_key, normalized_text ORDER BY trust_rank DESC, link_score DESC, ord) = 1)
"""
CONSENSUS = """
, forms_of AS (SELECT normalized_text, form_key, list(DISTINCT variable) AS vars, min(ord) AS ord FROM acc GROUP BY ALL),
keys AS (SELECT DISTINCT form_key, normalized_text, domain FROM facts),
others AS (
  SELECT k.form_key, k.normalized_text, list_sort(list_distinct(flatten(list(f.vars)))) AS vars, count(DISTINCT f.form_key) AS forms, min(f.ord) AS ord
  FROM keys k JOIN forms_of f ON k.normalized_text = f.normalized_text AND k.form_key <> f.form_key GROUP BY ALL),
consensus AS (
  SELECT o.form_key, o.normalized_text, 'CROSS_FORM_CONSENSUS' AS tier,
         (CASE WHEN len(vars) > 1 THEN 0.0 ELSE round(least(0.85, 0.55 + 0.05 * forms), 3) END)::DOUBLE AS confidence,
         CASE WHEN len(vars) > 1 THEN '' ELSE vars[1] END AS variable,
         CASE WHEN len(vars) > 1 THEN '' ELSE (SELECT source FROM acc a WHERE a.ord = o.ord) END AS source
  FROM others o WHERE len(vars) > 1 OR forms >= 2)
"""
SUFFIXES = """
, suffixes AS (
  SELECT normalized_text, substr(upper(variable), length(domain) + 1) AS suffix, list_sort(list(DISTINCT domain)) AS domains
  FROM acc WHERE starts_with(upper(variable), domain) AND length(variable) > length(domain) AND regexp_matches(substr(upper(variable), length(domain) + 1), '^[A-Z][A-Z0-9]{1,6}$') GROUP BY ALL)
"""
PATTERN = """
, single AS (SELECT normalized_text, any_value(suffix) AS suffix, any_value(domains) AS domains FROM suffixes GROUP BY 1 HAVING count(*) = 1 AND len(any_value(domains)) >= 2),
pattern AS (
  SELECT form_key, k.normalized_text, 'DOMAIN_PATTERN' AS tier, round(least(0.85, 0.6 + 0.05 * len(domains)), 3)::DOUBLE AS confidence, domain || suffix AS variable,
         'convention ' || suffix || ' in ' || array_to_string(domains, ', ') AS source
  FROM keys k JOIN single s ON k.normalized_text = s.normalized_text)
"""
TIERS = """
, every AS (
  SELECT *, 1 AS tier_rank FROM exact UNION ALL SELECT *, 2 FROM consensus UNION ALL SELECT *, 3 FROM pattern),
judged AS (
  SELECT e.form_key, e.normalized_text, tier, tier_rank, variable, source, CASE WHEN n.field_key IS NOT NULL AND variable <> '' THEN 0.0 ELSE confidence END::DOUBLE AS confidence
  FROM every e LEFT JOIN no n ON n.field_key = e.form_key || '|' || e.normalized_text AND n.annotation_text = e.variable),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY form_key, normalized_text ORDER BY confidence DESC, tier_rank) = 1)
"""
SQL = {
    "rejected_suggestions": FACTS + "SELECT field_key, variable AS annotation_text, variable, file_name FROM facts WHERE rejected",
    "kb_stats": FACTS + "SELECT (SELECT count(DISTINCT file_name) FROM facts) AS documents, (SELECT count(DISTINCT form_key) FROM facts) AS forms, (SELECT count(DISTINCT field_key) FROM facts) AS fields, count(*) AS annotations, count(*) FILTER (NOT rejected) AS links, (SELECT count(DISTINCT field_key) FROM acc) AS mapped_keys FROM facts",
    "field_map": FACTS + "SELECT field_key, form_name, field_text, count(*) AS occurrences, count(DISTINCT annotation_text) AS variants, string_agg(DISTINCT annotation_text, ',' ORDER BY annotation_text) AS annotation_texts, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables, max(link_score) AS best_link_score FROM acc GROUP BY ALL",
    "disagreements": FACTS + "SELECT field_key, count(*) AS occurrences, count(DISTINCT annotation_text) AS variants, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables FROM acc GROUP BY field_key, form_name, field_text HAVING count(DISTINCT annotation_text) > 1",
    "field_map_of_form": FACTS + "SELECT field_key, count(*) AS occurrences, max(link_score) AS best_link_score FROM acc WHERE starts_with(field_key, 'nation_7|') GROUP BY field_key, form_name, field_text",
    "lookup_best": FACTS + "SELECT field_key, variable, link_score FROM acc WHERE variable <> '' QUALIFY row_number() OVER (PARTITION BY field_key ORDER BY link_score DESC, ord) = 1",
    "lookup_key": FACTS + "SELECT file_name, variable, link_score, ord FROM acc WHERE field_key = (SELECT min(field_key) FROM acc)",
    "exact_key_winner": FACTS + EXACT + "SELECT form_key, normalized_text, confidence, variable, source FROM exact",
    "consensus": FACTS + CONSENSUS + "SELECT form_key, normalized_text, confidence, variable, source FROM consensus",
    "suffixes": FACTS + SUFFIXES + "SELECT normalized_text, suffix, array_to_string(domains, ',') AS domains FROM suffixes",
    "domain_pattern": FACTS + CONSENSUS + SUFFIXES + PATTERN + "SELECT form_key, normalized_text, confidence, variable, source FROM pattern",
    "form_domain_mode": FACTS + "SELECT form_key, domain, n AS votes FROM (SELECT form_key, domain, count(*) AS n, min(ord) AS o FROM acc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY form_key ORDER BY n DESC, o) = 1",
    "aliases": FACTS + "SELECT form_key, variable, array_to_string(list_sort(list(DISTINCT field_text)), ',') AS labels FROM acc WHERE variable <> '' GROUP BY form_key, variable",
    "rejection_suppression": FACTS + EXACT + "SELECT e.form_key, e.normalized_text, variable, (CASE WHEN n.field_key IS NOT NULL THEN 0.0 ELSE confidence END)::DOUBLE AS confidence FROM exact e LEFT JOIN no n ON n.field_key = e.form_key || '|' || e.normalized_text AND n.annotation_text = variable",
    "prefill_tiers": FACTS + EXACT + CONSENSUS + SUFFIXES + PATTERN + TIERS + "SELECT form_key, normalized_text, tier, variable, confidence, CASE WHEN tier = 'EXACT_KEY' AND confidence >= 0.9 THEN 'AUTO' WHEN confidence >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'NEEDS_MAPPING' END AS status FROM best",
    "prefill_summary": FACTS + EXACT + CONSENSUS + SUFFIXES + PATTERN + TIERS + ", st AS (SELECT CASE WHEN tier = 'EXACT_KEY' AND confidence >= 0.9 THEN 'AUTO' WHEN confidence >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'NEEDS_MAPPING' END AS status FROM best) SELECT count(*) AS fields, count(*) FILTER (status = 'AUTO') AS auto, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'NEEDS_MAPPING') AS reaches_agent, round(count(*) FILTER (status = 'AUTO') / count(*), 3) AS auto_fill_rate FROM st",
    "fuzzy_tokens": FACTS + r""", labels AS (SELECT DISTINCT form_key, normalized_text AS t FROM acc),
s AS (SELECT form_key, t, list_distinct(list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END)) AS k FROM labels),
p AS (SELECT a.form_key, a.t AS a, b.t AS b, len(list_intersect(a.k, b.k))::DOUBLE AS shared, len(list_distinct(list_concat(a.k, b.k))) AS u, least(len(a.k), len(b.k)) AS m FROM s a JOIN s b ON a.form_key = b.form_key)
SELECT form_key, a, b, round(0.35 * CASE WHEN m = 1 THEN shared / u ELSE shared / m END + 0.25 * shared / u, 6) AS token_part FROM p""",
    "house_style": FACTS + """, v AS (
  SELECT coalesce(g, '*') AS scope, * EXCLUDE (g) FROM (
    SELECT CASE WHEN grouping(annot) = 0 THEN annot END AS g, count(*) AS samples, round(median(offset_x_pct), 4) AS offset_x_pct, round(median(offset_y_pct), 4) AS offset_y_pct
    FROM (SELECT *, CASE WHEN page <= 2 THEN 'VARIABLE' WHEN page <= 4 THEN 'SUPP_QUALIFIER' ELSE 'NOTE' END AS annot FROM acc) GROUP BY GROUPING SETS ((annot), ()))),
r AS (SELECT s.scope, a.* FROM (SELECT *, CASE WHEN page <= 2 THEN 'VARIABLE' WHEN page <= 4 THEN 'SUPP_QUALIFIER' ELSE 'NOTE' END AS annot FROM acc) a JOIN v s ON s.scope = '*' OR s.scope = annot),
m AS (
  SELECT scope, kind, val, round(n / sum(n) OVER (PARTITION BY scope, kind), 3) AS share, row_number() OVER (PARTITION BY scope, kind ORDER BY n DESC, o) AS k
  FROM (SELECT scope, kind, val, count(*) AS n, min(ord) AS o FROM (
    SELECT scope, ord, 'color' AS kind, text_color AS val FROM r UNION ALL SELECT scope, ord, 'font', font_name FROM r
    UNION ALL SELECT scope, ord, 'size', font_size::VARCHAR FROM r UNION ALL SELECT scope, ord, 'place', relative_label FROM r) GROUP BY ALL)),
t AS (SELECT scope, max(val) FILTER (kind = 'color') AS text_color, max(share) FILTER (kind = 'color') AS color_agreement, max(val) FILTER (kind = 'font') AS font_name, max(share) FILTER (kind = 'font') AS font_agreement,
        max(val) FILTER (kind = 'size')::DOUBLE AS font_size, max(share) FILTER (kind = 'size') AS size_agreement, max(val) FILTER (kind = 'place') AS placement, max(share) FILTER (kind = 'place') AS placement_agreement FROM m WHERE k = 1 GROUP BY scope)
SELECT t.*, samples, offset_x_pct, offset_y_pct, samples >= 3 AND least(color_agreement, font_agreement, size_agreement) >= 0.7 AS settled FROM t JOIN v USING (scope)""",
}
