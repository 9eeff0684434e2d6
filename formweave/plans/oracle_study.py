"""DuckDB SQL for the queries over a stored corpus and over a study made from document lines."""

from .oracle_boxes import LINES
from .oracle_boxes import SQL as BOXES
from .oracle_facts import CONSENSUS, EXACT, FACTS, PATTERN, SUFFIXES, TIERS
from .oracle_facts import SQL as OF_FACTS
from .oracle_pages import norm

KEPT = FACTS + """, stored AS (SELECT *, 'f' || ord AS field_id, upper(form_name) AS stored_form, variable AS annotation_text FROM facts WHERE ord % 50 <> 0 AND n_key % 6 <> 5)
"""
KEPT = KEPT.replace("l_linenumber AS page,", "l_linenumber AS page, n_nationkey AS n_key,")
PLACED = KEPT + """, boxes AS (
  SELECT *, 160 + offset_x_pct::DOUBLE * 100 AS ax0, 220 + offset_x_pct::DOUBLE * 100 AS ax1, page * 20 + offset_y_pct::DOUBLE * 300 AS ay0, page * 20 + 10 + offset_y_pct::DOUBLE * 300 AS ay1, page * 20 AS fy0, page * 20 + 10 AS fy1 FROM stored WHERE NOT rejected),
place AS (
  SELECT ord, file_name, field_id, page, CASE WHEN greatest(0, least(ay1, fy1) - greatest(ay0, fy0)) > 0 THEN CASE WHEN ax0 >= 160 THEN 'right_of_field' WHEN ax1 <= 60 THEN 'left_of_field' ELSE 'overlapping_field' END
         WHEN (ay0 + ay1) / 2 > (fy0 + fy1) / 2 THEN 'below_field' ELSE 'above_field' END AS label FROM boxes),
marks AS (SELECT * FROM facts WHERE ord % 50 <> 0),
modes AS (
  SELECT kind, val, round_even(n / sum(n) OVER (PARTITION BY kind), 3) AS share, row_number() OVER (PARTITION BY kind ORDER BY n DESC, o) AS k FROM (
    SELECT 'size' AS kind, font_size::VARCHAR AS val, count(*) AS n, min({'d': file_name, 'p': page, 'o': ord::VARCHAR, 'i': ord}) AS o FROM marks GROUP BY ALL
    UNION ALL SELECT 'font', font_name, count(*), min({'d': file_name, 'p': page, 'o': ord::VARCHAR, 'i': ord}) FROM marks GROUP BY ALL
    UNION ALL SELECT 'place', label, count(*), min({'d': file_name, 'p': page, 'o': 'a' || ord, 'i': 0::BIGINT}) FROM place GROUP BY ALL))
"""
STAGED = FACTS + EXACT + CONSENSUS + SUFFIXES + PATTERN + TIERS + """, judged2 AS (SELECT *, CASE WHEN tier = 'EXACT_KEY' AND confidence >= 0.9 THEN 'AUTO' WHEN confidence >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'NEEDS_MAPPING' END AS status FROM best),
field AS (SELECT DISTINCT field_key, form_key, normalized_text, field_text, domain FROM facts),
labels AS (SELECT form_key, variable, list_sort(list(DISTINCT field_text)) AS labels FROM acc WHERE variable <> '' GROUP BY ALL),
rule AS (
  SELECT (SELECT font_size FROM acc GROUP BY font_size ORDER BY count(*) DESC, min(ord) LIMIT 1) AS size, (SELECT relative_label FROM acc GROUP BY relative_label ORDER BY count(*) DESC, min(ord) LIMIT 1) AS place, (SELECT round_even(median(offset_x_pct), 4) FROM acc) AS dx),
sheet AS (
  SELECT f.field_key AS row_id, length(field_text) || '.' AS item_number, f.domain || ' | other' AS options, 'BOX,CIRCLE' AS control, coalesce(b.variable, '') AS suggested_variable, coalesce(tier, 'NEEDS_MAPPING') AS match_tier, round_even(coalesce(confidence, 0), 3) AS match_score, coalesce(source, '') AS match_source,
    coalesce(array_to_string(list_filter(l.labels, lambda x: lower(x) <> f.normalized_text), ', '), '') AS known_aliases, CASE WHEN status = 'AUTO' THEN b.variable ELSE '' END AS final_variable, CASE WHEN status = 'AUTO' THEN 'VARIABLE' ELSE '' END AS final_annot_type,
    coalesce(status, 'NEEDS_MAPPING') AS status, printf('#%02X3333', round_even(size / 25 * 255, 0)::INT) AS color_rgb, size::VARCHAR AS font_size, place AS placement, round_even((60 + 2.5 * length(field_text)) / 595, 4) AS rel_x, round_even((105 + length(field_text)) / 842, 4) AS rel_y,
    round_even(5 * length(field_text) / 595, 4) AS rel_w, dx AS offset_x
  FROM field f LEFT JOIN judged2 b ON b.form_key = f.form_key AND b.normalized_text = f.normalized_text LEFT JOIN labels l ON l.form_key = f.form_key AND l.variable = b.variable, rule)
"""
STUDY = LINES + f""", w AS (SELECT *, 's' || (page % 4) AS doc_id, 'form ' || (page % 3) AS form_key, split_part(text, ' ', 1) AS word FROM l WHERE ord < 20),
first AS (SELECT 's' || (doc_id % 4) AS doc_id, 'form ' || (doc_id % 3) AS form_key, min(documents.doc_id) AS first_page, count(*) AS pages FROM documents GROUP BY ALL),
field AS (
  SELECT w.doc_id, w.form_key, page, ord, 'p' || page || 'f' || ord AS field_id, word, {norm('word')} AS nt, page - first_page AS off, 0.5 + ord % 5 / 10 AS confidence, CASE WHEN ord % 4 = 0 THEN 'BOX' ELSE 'CIRCLE' END AS kind,
    round_even((x0 + x1) / 2 / 595, 4) AS rx, round_even((y0 + y1) / 2 / 842, 4) AS ry, CASE WHEN ord % 6 = 0 AND page % 10 <> 0 THEN substr(word, 1, 4) END AS note
  FROM w JOIN first o ON o.doc_id = w.doc_id AND o.form_key = w.form_key WHERE ord % 2 = 0 AND {norm('word')} <> ''),
entry AS (
  SELECT doc_id, form_key, nt, arg_min(word, {{'p': page, 'o': ord}}) AS field_text, count(*)::INT AS occurrences, list_sort(list(DISTINCT off)) AS offs, max(confidence)::DOUBLE AS confidence, arg_min(rx, {{'a': note IS NULL, 'p': page, 'o': ord}}) AS rx, arg_min(ry, {{'a': note IS NULL, 'p': page, 'o': ord}}) AS ry,
    string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT note)::INT AS notes, arg_min(note, {{'p': page, 'o': ord}}) FILTER (note IS NOT NULL) AS note, min({{'f': page - off, 'p': page, 'o': ord}}) AS e_ord
  FROM field GROUP BY ALL)
"""
WHOLE = STUDY.replace("split_part(text, ' ', 1) AS word FROM l WHERE ord < 20", "text AS word FROM l")
APPLY = STUDY + """, blank AS (SELECT * FROM field WHERE doc_id = 's1'), e AS (SELECT * FROM entry WHERE doc_id = 's0'),
exact AS (SELECT b.field_id, 'EXACT_KEY' AS method, 0.95 AS confidence, e.notes FROM blank b JOIN e USING (form_key, nt)),
close AS (
  SELECT b.field_id, 'POSITION' AS method, round_even(0.6 * (1 - greatest(abs(b.rx - e.rx), abs(b.ry - e.ry)) / 0.04) + 0.2, 2) AS confidence, e.notes FROM blank b JOIN e ON b.form_key = e.form_key AND list_contains(e.offs, b.off)
  WHERE b.field_id NOT IN (SELECT field_id FROM exact) AND greatest(abs(b.rx - e.rx), abs(b.ry - e.ry)) < 0.04::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY b.field_id ORDER BY greatest(abs(b.rx - e.rx), abs(b.ry - e.ry)), e_ord) = 1),
text AS (
  SELECT b.field_id, 'TEXT_ONLY' AS method, 0.3 AS confidence, e.notes FROM blank b JOIN e ON b.nt = e.nt AND b.form_key <> e.form_key
  WHERE b.field_id NOT IN (SELECT field_id FROM exact) AND b.field_id NOT IN (SELECT field_id FROM close) QUALIFY row_number() OVER (PARTITION BY b.field_id ORDER BY e_ord) = 1),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM close UNION ALL SELECT * FROM text),
applied AS (SELECT b.field_id, coalesce(method, '') AS method, coalesce(f.confidence, 0)::DOUBLE AS confidence, coalesce(notes, 0)::INT AS notes FROM blank b LEFT JOIN found f USING (field_id))
"""
BUILT = STUDY + "SELECT o.doc_id, 1 AS template_version, o.doc_id || '.v1' AS name, o.form_key AS form, o.pages::INT AS pages, (o.pages - 1)::INT AS continued, (SELECT count(*) FROM entry e WHERE e.doc_id = o.doc_id AND e.form_key = o.form_key)::INT AS fields FROM first o"
LINKED = BOXES["link_candidates"].replace("SELECT page, annotation_id, field_id, round(score, 6) AS score FROM s WHERE score >= 0.35", "")

SQL = {
    "facts_join": KEPT + "SELECT file_name, stored_form AS form_name, domain, field_key, field_text, normalized_text, variable, link_score, trust, 0.5::DOUBLE AS field_confidence, field_id FROM stored WHERE NOT rejected",
    "view_field_annotations": KEPT + "SELECT file_name, stored_form AS form_name, field_key, annotation_text, link_score, trust, field_id FROM stored WHERE NOT rejected",
    "view_rejected_suggestions": KEPT + "SELECT field_key, annotation_text, variable, file_name FROM stored WHERE trust = 'HUMAN_REJECTED'",
    "view_field_map": KEPT + "SELECT field_key, stored_form AS form_name, field_text, count(*) AS occurrences, count(DISTINCT variable) AS variants, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables, max(link_score) AS best_link_score FROM stored WHERE NOT rejected GROUP BY ALL",
    "forms_list": "SELECT upper(n_name) AS name, chr((65 + n_nationkey // 5)::INT) || chr((75 + n_nationkey % 5)::INT) AS domain, 1 AS pages, 0.9::DOUBLE AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 6 <> 5",
    "point_lookups": "SELECT 'page' AS what, '3' AS found UNION ALL SELECT 'form', (SELECT count(*) FROM supplier WHERE s_nationkey = 7)::VARCHAR",
    "link_rows": LINKED + """SELECT s.page, s.annotation_id, s.field_id,
  CASE WHEN greatest(0, least(a.y1, f.y1) - greatest(a.y0, f.y0)) > 0 THEN CASE WHEN a.x0 >= f.x1 THEN 'right_of_field' WHEN a.x1 <= f.x0 THEN 'left_of_field' ELSE 'overlapping_field' END WHEN (a.y0 + a.y1) / 2 > (f.y0 + f.y1) / 2 THEN 'below_field' ELSE 'above_field' END AS relative_label,
  round_even((a.x0 - f.x1) / 595, 4) AS offset_x_pct, round_even(((a.y0 + a.y1) / 2 - (f.y0 + f.y1) / 2) / 842, 4) AS offset_y_pct
FROM s JOIN a ON a.page = s.page AND 'a' || a.ord = s.annotation_id AND a.ord % 21 <> 4 JOIN f ON f.page = s.page AND 'f' || f.ord = s.field_id AND f.ord % 10 <> 4 WHERE score >= 0.35""",
    "index_from_documents": KEPT + "SELECT form_key, normalized_text, 0.95::DOUBLE AS confidence, variable FROM stored WHERE NOT rejected QUALIFY row_number() OVER (PARTITION BY form_key, normalized_text ORDER BY link_score DESC, file_name, field_id) = 1",
    "style_of_corpus": PLACED + """SELECT scope, (SELECT count(*) FROM marks) AS samples, s.val::DOUBLE AS font_size, s.share AS size_agreement, f.val AS font_name, f.share AS font_agreement, p.val AS placement, p.share AS placement_agreement, false AS settled, s.val::DOUBLE / 25 AS red
FROM (SELECT unnest(['VARIABLE', '*']) AS scope), (SELECT * FROM modes WHERE kind = 'size' AND k = 1) s, (SELECT * FROM modes WHERE kind = 'font' AND k = 1) f, (SELECT * FROM modes WHERE kind = 'place' AND k = 1) p""",
    "style_for_type": FACTS + """, t AS (SELECT *, CASE WHEN ord % 100000 = 7 THEN 'NOTE' ELSE 'VARIABLE' END AS kind FROM acc),
r AS (SELECT kind AS scope, * FROM t UNION ALL SELECT '*', * FROM t),
n AS (SELECT scope, count(*) AS samples FROM r GROUP BY scope),
s AS (SELECT scope, font_size FROM r GROUP BY scope, font_size QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, min(ord)) = 1), p AS (SELECT scope, relative_label FROM r GROUP BY scope, relative_label QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, min(ord)) = 1),
u AS (SELECT annot_type, CASE WHEN coalesce((SELECT samples FROM n WHERE scope = annot_type), 0) >= 3 THEN annot_type ELSE '*' END AS scope FROM (SELECT unnest(['VARIABLE', 'NOTE', 'DERIVATION_RULE']) AS annot_type))
SELECT annot_type, s.font_size, p.relative_label AS placement, n.samples FROM u JOIN s USING (scope) JOIN p USING (scope) JOIN n USING (scope)""",
    "staging_rows": STAGED + "SELECT * FROM sheet",
    "staging_summary": STAGED + "SELECT status, count(*) AS rows FROM sheet GROUP BY status",
    "worksheet_files": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, 'r' || n_nationkey AS row_id, n_name AS field_text, 'AUTO' AS status, n_nationkey / 4 AS font_size FROM nation",
    "template_entries": STUDY + """SELECT doc_id, form_key, nt AS normalized_text, field_text, occurrences, array_to_string(offs, ',') AS offsets, round_even(confidence, 2) AS confidence, rx AS rel_x_pct, ry AS rel_y_pct, kinds, notes, note, CASE WHEN note IS NOT NULL THEN 'right_of_field' END AS label FROM entry""",
    "template_build": BUILT,
    "template_files": BUILT,
    "template_apply": APPLY + "SELECT * FROM applied",
    "template_loaded_apply": APPLY + "SELECT * FROM applied",
    "template_summary": APPLY + "SELECT CASE WHEN method = '' THEN 'UNMATCHED' ELSE method END AS method, count(*) AS n FROM applied GROUP BY 1",
    "json_files": WHOLE + """SELECT o.doc_id, o.doc_id || '.v1.pdf' AS file_name, count(*)::INT AS forms, (SELECT count(*) FROM field f WHERE f.doc_id = o.doc_id)::INT AS fields, (SELECT count(*) FROM w WHERE w.doc_id = o.doc_id AND ord % 6 = 0)::INT AS links,
  (SELECT count(*) FROM w WHERE w.doc_id = o.doc_id AND ord % 6 = 0 AND page % 10 = 0)::INT AS rejected FROM first o GROUP BY o.doc_id""",
    "box_geometry": """WITH k AS (
  SELECT p_partkey AS id, round_even(least(p_partkey % 50 * 7 + 0.123::DOUBLE, p_size * 5), 2) AS x0, round_even(least(p_size * 3, p_partkey % 31 * 4 + 0.456::DOUBLE), 2) AS y0, round_even(greatest(p_partkey % 50 * 7 + 0.123::DOUBLE, p_size * 5), 2) AS x1, round_even(greatest(p_size * 3, p_partkey % 31 * 4 + 0.456::DOUBLE), 2) AS y1,
    (p_size * 6)::DOUBLE AS u0, (p_partkey % 17 * 5)::DOUBLE AS v0, (p_size * 6 + 40)::DOUBLE AS u1, (p_partkey % 17 * 5 + 30)::DOUBLE AS v1 FROM part),
s AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) AS h, greatest(0, least(y1, v1) - greatest(y0, v0)) AS v, x1 - x0 AS wd, y1 - y0 AS ht FROM k)
SELECT id, x0, y0, x1, y1, round_even(wd, 3) AS w, round_even(ht, 3) AS h, round_even(wd * ht, 3) AS area, round_even((x0 + x1) / 2, 3) AS cx, round_even(CASE WHEN least(ht, 30) > 0 THEN s.v / least(ht, 30) ELSE 0 END, 6) AS v, round_even(CASE WHEN least(wd, 40) > 0 THEN s.h / least(wd, 40) ELSE 0 END, 6) AS o,
  round_even(CASE WHEN wd * ht > 0 THEN s.h * s.v / (wd * ht) ELSE 0 END, 6) AS inside, greatest(u0 - x1, x0 - u1) <= 30 AS near, CASE WHEN wd <= 0 THEN true ELSE greatest(0, least(x1, 150) - greatest(x0, 50)) / wd >= 0.5 END AS banded, round_even((x0 + x1) / 2 / 595, 4) AS rel_x, round_even(ht / 842, 4) AS rel_h,
  CASE WHEN least(ht, 30) > 0 AND s.v / least(ht, 30) > 0 THEN CASE WHEN x0 >= u1 THEN 'right_of_field' WHEN x1 <= u0 THEN 'left_of_field' ELSE 'overlapping_field' END WHEN (y0 + y1) / 2 > (v0 + v1) / 2 THEN 'below_field' ELSE 'above_field' END AS label FROM s""",
    "unsettled_rules": f"SELECT scope, samples FROM ({OF_FACTS['house_style']}) WHERE NOT settled",
}
