"""DuckDB SQL for the queries over extracted layers made from parts."""

from .oracle_text import CLASSIFY, STRINGS, filled

_LISTED = filled("NOT contains(text, '=') AND regexp_matches(text, <VARIABLE_LIST>) AND len(list_filter(string_split_regex(text, <SEPARATOR>), lambda w: w <> '' AND NOT regexp_matches(w, <PURE_VARIABLE>))) = 0")
PARTS = STRINGS.replace("\ns AS (", "\nwhole AS (") + rf""", marks AS (SELECT id, id // 7 AS page, trim(text) AS text, text AS raw, row_number() OVER (PARTITION BY id // 7 ORDER BY id) AS nth FROM whole),
cut AS (SELECT id, page, nth, raw, CASE WHEN {_LISTED} THEN list_filter(string_split_regex(text, '\s*[,/|]\s*|\s+'), lambda w: w <> '') ELSE [text] END AS parts FROM marks),
s AS (SELECT id * 100 + i - 1 AS id, nth = 1 AS first, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut))
"""
_BEFORE, _, _LAST = CLASSIFY.replace(STRINGS, PARTS).rpartition("\nSELECT id, text,")
STATEMENTS = _BEFORE + ", judged AS (SELECT id, text," + _LAST + """)
"""
BEST = STATEMENTS.rstrip() + """, one AS (SELECT id // 100 AS mark, count(*) OVER (PARTITION BY id // 100) AS n, * FROM judged QUALIFY row_number() OVER (PARTITION BY id // 100 ORDER BY confidence DESC, id) = 1),
found AS (SELECT m.page, 'p' || m.page || 'a' || (m.nth - 1) AS annotation_id, m.raw AS text, annot_type, confidence AS type_confidence, variable, domain, n::INT AS statements FROM marks m JOIN one ON one.mark = m.id)
"""
SQL = {
    "dominant_spans": """WITH s AS (SELECT p_partkey // 40 AS page, p_partkey // 5 % 8 AS block_no, p_partkey % 5 // 3 AS line_no, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS text, p_size::DOUBLE AS size, CASE WHEN p_partkey % 7 = 0 THEN 'Some-BOLD' ELSE p_type END AS font, p_partkey % 32 AS flags FROM part),
m AS (SELECT page, block_no, line_no, string_agg(text, '' ORDER BY k) AS text FROM s GROUP BY ALL), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, block_no, line_no ORDER BY length(text) DESC, k) = 1)
SELECT m.page, m.block_no, m.line_no, m.text, t.size, t.font, flags & 16 <> 0 OR contains(lower(font), 'bold') AS bold FROM m JOIN t USING (page, block_no, line_no)""",
    "drawings": """WITH d AS (SELECT p_partkey // 50 AS page, p_partkey AS ord, p_size % 12 * 40 + 1 AS w, p_partkey % 5 * 2 AS h, p_partkey % 2 = 0 AS curved FROM part),
k AS (SELECT *, CASE WHEN h <= 2 AND w > 4 THEN 'H' WHEN w <= 2 AND h > 4 THEN 'V' WHEN w >= 4 AND h >= 4 THEN CASE WHEN curved THEN 'CIRCLE' ELSE 'BOX' END END AS kind FROM d)
SELECT page, ord, kind, CASE kind WHEN 'H' THEN round_even(w / 595, 4) WHEN 'V' THEN round_even(h / 842, 4) END AS span_pct FROM k WHERE kind IS NOT NULL""",
    "annotation_layer": """WITH a AS (SELECT p_partkey AS k, *, p_partkey % 5 = 0 AS own, p_partkey % 3 = 0 AS helv FROM part)
SELECT k AS ord, CASE WHEN k % 4 < 2 THEN p_brand ELSE p_name || ' x' END AS text, CASE WHEN own THEN 'Cour' WHEN helv THEN 'Helv' ELSE '' END AS font_name, (CASE WHEN own THEN p_size WHEN helv THEN 9 ELSE 0 END)::DOUBLE AS font_size, (CASE WHEN own THEN 0.5 WHEN helv THEN 1 END)::DOUBLE AS red,
  CASE WHEN k % 2 = 0 THEN round_even(k / 7, 3) WHEN k % 3 = 0 THEN 0.123 END::DOUBLE AS first, CASE WHEN k % 2 = 0 THEN 3 WHEN k % 3 = 0 THEN 1 ELSE 0 END::INT AS channels FROM a""",
    "extract_annotations": BEST + "SELECT page, annotation_id, text, annot_type, type_confidence, variable, domain, statements FROM found",
    "statement_rows": STATEMENTS + "SELECT id // 100 AS ord, (id % 100)::INT AS part, text AS part_text, annot_type, confidence FROM judged",
    "annotations_summary": BEST + "SELECT annot_type, count(*) AS annotations, sum(statements)::BIGINT AS statements, count(*) FILTER (type_confidence <= 0.55) AS ambiguous FROM found GROUP BY annot_type",
}
