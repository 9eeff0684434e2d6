"""DuckDB SQL for the queries over pages made from document lines."""

from ..functions.text import CONTINUED, DOMAIN_HEADER, ITEM_NUMBER, LEADING, LIST_CONTINUES, NEW_ITEM, SEE_PAGE, TERMINATED, TITLE_PREFIX, TRAILING
from .oracle_boxes import LINES, overlap
from .oracle_text import FILL


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def norm(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({text}, '\s+', ' ', 'g'))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def title(text: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({text}), {quoted(TITLE_PREFIX)}, '\\1'), {quoted(CONTINUED)}, '')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '^[ \-–:()\[\]]+|[ \-–:()\[\]]+$', '', 'g'), '\s+', ' ', 'g'))"


def in_band(b: str, x0: str, x1: str, share: float) -> str:
    return f"(CASE WHEN {b}x1 <= {b}x0 THEN true ELSE greatest(0, least({b}x1, {x1}) - greatest({b}x0, {x0})) / ({b}x1 - {b}x0) >= {share} END)"


def near(a: str, b: str, reach: int) -> str:
    return f"greatest({b}x0 - {a}x1, {a}x0 - {b}x1) <= {reach}"


BASE = LINES + """, c AS (SELECT page, ord, x1 + 15 AS x0, x1 + 27 AS x1, y0 + 1 AS y0, y1 - 1 AS y1, CASE WHEN ord % 8 = 0 THEN 'BOX' ELSE 'CIRCLE' END AS kind FROM l WHERE ord % 4 = 0),
bd AS (SELECT doc_id AS page, 0 AS i, 0 AS x0, 595 AS x1, 'UNKNOWN' AS hint FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 0, 0, 290, 'QUESTION_ZONE' FROM documents WHERE doc_id % 3 <> 0
       UNION ALL SELECT doc_id, 1, 290, 595, 'RESPONSE_ZONE' FROM documents WHERE doc_id % 3 <> 0),
g AS (SELECT page, ord AS gid, CASE WHEN ord % 5 = 2 THEN text || ':' ELSE text END AS text, x0, y0, x1, y1, size, bold, CASE WHEN ord = 0 THEN 'HEADER' WHEN ord >= 40 THEN 'FOOTER' ELSE 'BODY' END AS region, col, ord % 13 = 12 AS markup FROM l)
"""
ANCHORS = BASE + f""", anchor AS (
  SELECT DISTINCT page, ord FROM (
    SELECT l.page, l.ord FROM l JOIN c ON c.page = l.page LEFT JOIN bd ON bd.page = l.page AND bd.i = l.col
    WHERE {overlap('c.', 'l.', 'y')} >= 0.5 AND (bd.i IS NULL OR {in_band('c.', 'bd.x0', 'bd.x1', 0.3)}) AND {near('l.', 'c.', 72)}
    QUALIFY row_number() OVER (PARTITION BY l.page, c.ord ORDER BY l.y0, l.ord) = 1))
"""
ROLES = BASE + rf""", m AS (SELECT page, median(size) AS mid FROM g WHERE region = 'BODY' AND NOT markup GROUP BY page),
flags AS (
  SELECT g.*, coalesce(m.mid, 0) AS mid, n.n AS bands, own.i IS NOT NULL AS banded, coalesce(own.hint, 'UNKNOWN') AS hint, regexp_matches(g.text, {quoted(TERMINATED)}) AS ended,
    EXISTS (SELECT 1 FROM c WHERE c.page = g.page AND c.x0 >= g.x1 AND {overlap('c.', 'g.', 'y')} >= 0.5) AS to_right,
    coalesce(EXISTS (SELECT 1 FROM c WHERE c.page = g.page AND {overlap('c.', 'g.', 'y')} >= 0.5 AND {in_band('c.', 'own.x0', 'own.x1', 0.3)} AND {near('g.', 'c.', 72)}), false) AS held,
    len(string_split_regex(trim(g.text), '\s+')) <= 4 AS brief, (SELECT count(*) FROM bd WHERE bd.page = g.page AND {in_band('g.', 'bd.x0', 'bd.x1', 0.2)}) > 1 AS spans
  FROM g LEFT JOIN m ON m.page = g.page LEFT JOIN bd own ON own.page = g.page AND own.i = g.col JOIN (SELECT page, count(*) AS n FROM bd GROUP BY page) n ON n.page = g.page),
points AS (
  SELECT *, bands >= 2 AND banded AND held AS own, brief AND NOT ended AS short, (CASE WHEN hint = 'QUESTION_ZONE' THEN 0.5 ELSE 0 END + CASE WHEN ended THEN 0.3 ELSE 0 END + CASE WHEN to_right THEN 0.3 ELSE 0 END) AS q FROM flags),
sums AS (SELECT *, (CASE WHEN hint = 'RESPONSE_ZONE' THEN 0.5 ELSE 0 END + CASE WHEN own THEN 0.4 ELSE 0 END + CASE WHEN short THEN 0.1 ELSE 0 END) AS r,
           (hint IN ('QUESTION_ZONE', 'RESPONSE_ZONE'))::INT + ended::INT + to_right::INT + own::INT + short::INT AS why, (bold OR size > mid + 0.5) AND (bands < 2 OR spans) AS heading FROM points),
roles AS (
  SELECT *, CASE WHEN markup THEN 'UNKNOWN' WHEN region = 'HEADER' THEN 'PAGE_HEADER' WHEN region = 'FOOTER' THEN 'FOOTER' WHEN heading THEN 'SECTION_HEADER' WHEN greatest(q, r) = 0 THEN 'UNKNOWN' WHEN q >= r THEN 'QUESTION' ELSE 'RESPONSE_OPTION' END AS role,
    (CASE WHEN markup THEN 0 WHEN region <> 'BODY' THEN 0.9 WHEN heading THEN 0.7 WHEN greatest(q, r) = 0 THEN 0 WHEN q >= r THEN least(q, 1) ELSE least(r, 1) END)::DOUBLE AS role_confidence,
    CASE WHEN markup OR region <> 'BODY' THEN 1 WHEN heading THEN why + 1 ELSE why END AS reasons
  FROM sums)
"""
CANDIDATES = ROLES + f""", named AS (SELECT d.doc_id AS page, coalesce(g.text, '') AS form_name FROM documents d LEFT JOIN g ON g.page = d.doc_id AND g.gid = 3),
cand AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.page ORDER BY y0, x0, gid) - 1 AS index FROM roles r JOIN named n ON n.page = r.page
  WHERE NOT markup AND trim(text) <> '' AND region = 'BODY' AND role NOT IN ('RESPONSE_OPTION', 'PAGE_HEADER', 'FOOTER', 'SECTION_HEADER') AND {norm('text')} <> {norm('n.form_name')})
"""
LABEL = f"trim(regexp_replace(regexp_replace(regexp_replace(f.text, {quoted(ITEM_NUMBER)}, ''), {quoted(LEADING)}, ''), {quoted(TRAILING)}, ''))"
EXTRACT = CANDIDATES + f""", head AS (SELECT r.page, gid, text, y0, y1 FROM roles r JOIN named n ON n.page = r.page WHERE NOT markup AND trim(text) <> '' AND role = 'SECTION_HEADER' AND {norm(title('text'))} <> {norm('n.form_name')}),
answer AS (
  SELECT f.page, f.index, c.kind FROM cand f JOIN c ON c.page = f.page LEFT JOIN bd own ON own.page = f.page AND own.i = f.col
  WHERE {overlap('c.', 'f.', 'y')} >= 0.5 AND c.x1 >= f.x0 AND (f.bands < 2 OR own.i IS NULL OR {in_band('c.', 'own.x0', 'own.x1', 0.3)})
    AND NOT EXISTS (SELECT 1 FROM cand o WHERE o.page = f.page AND o.index <> f.index AND {overlap('o.', 'f.', 'y')} >= 0.5 AND o.x0 >= f.x1 AND o.x0 < c.x0)),
kinds AS (SELECT page, index, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM answer GROUP BY page, index),
field AS (
  SELECT f.page, f.index, 'p' || f.page || 'f' || f.index AS field_id, {LABEL} AS label, f.x0, f.y0, f.x1, f.y1, f.col, f.gid,
    coalesce((SELECT h.text FROM head h WHERE h.page = f.page AND h.y1 <= f.y0 ORDER BY h.y0 DESC, h.gid DESC LIMIT 1), '') AS section, regexp_extract(f.text, {quoted(ITEM_NUMBER)}, 1) AS item_number, coalesce(k.kinds, '') AS kinds,
    round_even(least(1, CASE WHEN role = 'QUESTION' THEN role_confidence ELSE 0.2 END + CASE WHEN k.kinds IS NOT NULL THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence
  FROM cand f LEFT JOIN kinds k ON k.page = f.page AND k.index = f.index WHERE length({LABEL}) >= 1),
owner AS (
  SELECT o.page, o.gid, q.index FROM (SELECT * FROM roles WHERE NOT markup AND trim(text) <> '' AND role = 'RESPONSE_OPTION') o JOIN field q ON o.page = q.page AND o.col <> q.col
  WHERE {overlap('o.', 'q.', 'y')} >= 0.5 OR q.y0 <= (o.y0 + o.y1) / 2 + 4
  QUALIFY row_number() OVER (PARTITION BY o.page, o.gid ORDER BY {overlap('o.', 'q.', 'y')} >= 0.5 DESC, CASE WHEN {overlap('o.', 'q.', 'y')} >= 0.5 THEN {overlap('o.', 'q.', 'y')} ELSE q.y0 END DESC, q.index) = 1),
fields AS (SELECT f.*, (SELECT count(*) FROM owner o WHERE o.page = f.page AND o.index = f.index)::INT AS options FROM field f)
"""
HEADERS = LINES + """, note AS (
  SELECT doc_id AS page, 0 AS ord, 'DM=Demographics' AS text, 20 AS y0, 35 AS y1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, ' AE = Adverse Events ', 10, 25 FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 0, 'See Page ' || (doc_id % 7) || ', or see pg. ' || doc_id, 30, 45 FROM documents WHERE doc_id % 3 = 1),
t AS (SELECT page, ord AS gid, CASE WHEN ord = 2 AND page % 4 = 1 THEN 'Form: ' || text || CASE WHEN page % 8 = 1 THEN ' (continued)' ELSE '' END ELSE text END AS text, y0, y1, size, ord % 13 = 12 AS markup,
        CASE WHEN ord % 6 = 3 AND page % 5 <> 0 THEN 'SECTION_HEADER' ELSE 'QUESTION' END AS role FROM l)
"""
TITLES = HEADERS + f""", top AS (SELECT * FROM t WHERE NOT markup AND (y0 + y1) / 2 <= 842 * 0.35 AND trim(text) <> ''),
line AS (SELECT page, arg_min(text, gid) AS line FROM top WHERE regexp_matches(text, {quoted(TITLE_PREFIX)}) GROUP BY page),
head AS (SELECT page, text AS head FROM top WHERE role = 'SECTION_HEADER' QUALIFY row_number() OVER (PARTITION BY page ORDER BY y0, size DESC, gid) = 1),
dom AS (SELECT page, regexp_extract(trim(text), {quoted(DOMAIN_HEADER)}, 1) AS code, trim(regexp_extract(trim(text), {quoted(DOMAIN_HEADER)}, 2)) AS name FROM note WHERE regexp_matches(trim(text), {quoted(DOMAIN_HEADER)})
        QUALIFY row_number() OVER (PARTITION BY page ORDER BY y0, ord) = 1),
pages AS (SELECT doc_id AS page, line, head, code, name, coalesce(line, head, name) AS raw FROM documents d LEFT JOIN line ON line.page = d.doc_id LEFT JOIN head ON head.page = d.doc_id LEFT JOIN dom ON dom.page = d.doc_id)
SELECT page, coalesce(CASE WHEN line IS NOT NULL THEN {title(f"regexp_extract(line, {quoted(TITLE_PREFIX)}, 1)")} ELSE {title('raw')} END, '') AS form_name, raw AS raw_title,
  CASE WHEN line IS NOT NULL THEN 'TITLE_LINE' WHEN head IS NOT NULL THEN 'SECTION_HEADER' WHEN code IS NOT NULL THEN 'DOMAIN_ANNOTATION' END AS form_source,
  (CASE WHEN line IS NOT NULL THEN 0.95 WHEN head IS NOT NULL THEN 0.7 WHEN code IS NOT NULL THEN 0.6 ELSE 0 END)::DOUBLE AS form_confidence, coalesce(code, '') AS form_domain, coalesce(regexp_matches(raw, {quoted(CONTINUED)}), false) AS is_continuation
FROM pages"""
REFERENCES = HEADERS + f""", src AS (
  SELECT page, text, y0, y1, 0 AS s, ord AS o FROM note UNION ALL
  SELECT page, CASE WHEN gid = 4 THEN 'as in see page 3, see page 3 and See pg. 5' ELSE text END, y0, y1, 1, gid FROM t WHERE NOT markup),
hits AS (SELECT page, round_even((y0 + y1) / 2, 1) AS cy, s, o, unnest(regexp_extract_all(text, {quoted(SEE_PAGE)})) AS text, generate_subscripts(regexp_extract_all(text, {quoted(SEE_PAGE)}), 1) AS i FROM src),
found AS (SELECT *, regexp_extract(text, {quoted(SEE_PAGE)}, 1)::INT AS target_page FROM hits),
once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page, target_page, cy ORDER BY s, o, i) = 1)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY s, o, i) - 1)::INT AS ord, target_page, text, target_page BETWEEN 1 AND (SELECT count(*) FROM documents) AND target_page <> page AS resolved FROM once"""
INHERIT = FILL.replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT doc_id, list(page ORDER BY page) AS pages, list(coalesce(own, '') ORDER BY page) AS names FROM n GROUP BY doc_id),
walk AS (
  SELECT doc_id, 0 AS i, pages, names, list_transform(names, lambda x: CASE WHEN x <> '' THEN 'TITLE_LINE' END) AS sources FROM d
  UNION ALL
  SELECT doc_id, i + 1, pages, CASE WHEN names[i + 1] <> '' OR got = '' THEN names ELSE list_concat(names[1:i], [got], names[i + 2:]) END,
         CASE WHEN names[i + 1] <> '' OR got = '' THEN sources ELSE list_concat(sources[1:i], [CASE WHEN ref <> '' THEN 'CROSS_REFERENCE' ELSE 'INHERITED' END], sources[i + 2:]) END
  FROM (SELECT *, CASE WHEN ref <> '' THEN ref WHEN i > 0 THEN names[i] ELSE '' END AS got FROM (
    SELECT *, CASE WHEN (doc_id + pages[i + 1]) % 4 <> 0 THEN '' ELSE coalesce(list_filter(list_transform(list_filter([(doc_id * 3 + pages[i + 1]) % (len(pages) + 1), 0], lambda t: t <> pages[i + 1] AND t < len(pages)),
             lambda t: coalesce(names[list_position(pages, t)], '')), lambda x: x <> '')[1], '') END AS ref
    FROM walk WHERE i < len(pages))))
SELECT doc_id, unnest(pages) AS page, unnest(names) AS form_name, unnest(sources) AS form_source FROM walk WHERE i = len(pages)"""

SQL = {
    "anchors_argmin": ANCHORS + "SELECT page, ord FROM anchor",
    "column_of_line": BASE + f"""SELECT l.page, l.ord, (SELECT min(i) FROM bd WHERE bd.page = l.page AND {in_band('l.', 'bd.x0', 'bd.x1', 0.5)}) AS "column" FROM l""",
    "body_lines": BASE + "SELECT page, count(*) AS n, sum(gid)::BIGINT AS ids FROM g WHERE region = 'BODY' AND NOT markup AND trim(text) <> '' GROUP BY page",
    "page_text": BASE + "SELECT page, md5(string_agg(text, chr(10) ORDER BY gid)) AS text_md5 FROM g WHERE NOT markup GROUP BY page",
    "groups_of_role": ROLES + "SELECT page, gid::INT AS group_id FROM roles WHERE role = 'QUESTION'",
    "role_scoring": ROLES + "SELECT page, gid::INT AS group_id, role, role_confidence, reasons::INT AS reasons FROM roles",
    "field_candidates": CANDIDATES + "SELECT page, gid::INT AS group_id, index::INT AS index FROM cand",
    "extract_fields": EXTRACT + "SELECT page, field_id, md5(label) AS text_md5, md5(section) AS section_md5, item_number, kinds, confidence, options FROM fields",
    "fields_summary": EXTRACT + "SELECT count(*) AS fields, count(*) FILTER (options > 0) AS with_options, count(*) FILTER (kinds <> '') AS with_controls, count(*) FILTER (item_number <> '') AS numbered, count(*) FILTER (confidence < 0.5) AS low_confidence FROM fields",
    "page_titles": TITLES,
    "cross_references": REFERENCES,
    "form_inheritance": INHERIT,
    "page_forms": FILL + """, r AS (SELECT *, CASE WHEN page % 2 = 0 THEN 'DM' ELSE '' END AS dom FROM f),
o AS (SELECT doc_id, lower(form_name) AS k, min(page) AS first_page, CASE WHEN count(*) FILTER (dom <> '') > 0 THEN 'DM' ELSE '' END AS form_domain FROM r WHERE form_name <> '' GROUP BY ALL)
SELECT r.doc_id, r.page, form_name, CASE WHEN dom <> '' THEN dom ELSE coalesce(o.form_domain, '') END AS form_domain, coalesce(r.page <> first_page, false) AS is_continuation FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND o.k = lower(form_name)""",
    "label_keys": BASE + f"SELECT page, gid::INT AS group_id, {norm('text')} AS normalized_text, y1 < 421 AS upper_half FROM g",
    "group_lines": ANCHORS + f""", p AS (
  SELECT l.*, a.ord IS NOT NULL AS starts, lag(text) OVER w AS pt, lag(size) OVER w AS ps, lag(bold) OVER w AS pb, lag(block_no) OVER w AS pk, lag(col) OVER w AS pc, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1
  FROM l LEFT JOIN anchor a ON a.page = l.page AND a.ord = l.ord WINDOW w AS (PARTITION BY l.page ORDER BY col, y0, x0, l.ord)),
b AS (SELECT *, CASE WHEN coalesce(pc = col AND NOT starts AND NOT (page % 2 = 0 AND 87 BETWEEN py1 AND y0 AND greatest(0, least(560, px1) - greatest(50, px0)) > 0)
    AND NOT regexp_matches(text, {quoted(NEW_ITEM)}) AND NOT (regexp_matches(pt, {quoted(TERMINATED)}) AND NOT regexp_matches(text, {quoted(LIST_CONTINUES)}))
    AND abs(ps - size) <= 0.5 AND pb = bold AND y0 - py1 <= 0.5 * greatest(ps, size)
    AND (pk = block_no OR ((abs(px0 - x0) <= 2 OR abs(px1 - x1) <= 2 OR abs((px0 + px1) / 2 - (x0 + x1) / 2) <= 2) AND (greatest(0, least(px1, x1) - greatest(px0, x0)) / nullif(least(px1 - px0, x1 - x0), 0)) >= 0.3)), false) THEN 0 ELSE 1 END AS brk FROM p),
k AS (SELECT *, sum(brk) OVER (PARTITION BY page ORDER BY col, y0, x0, ord ROWS UNBOUNDED PRECEDING) - 1 AS group_id FROM b)
SELECT page, group_id::INT AS group_id, md5(list_reduce(list_prepend('', list(trim(text, ' ') ORDER BY col, y0, x0, ord)), lambda a, x: CASE WHEN a = '' THEN x WHEN ends_with(a, '-') THEN left(a, -1) || x ELSE a || ' ' || x END)) AS text_md5,
       count(*)::INT AS line_count, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(col) AS "column" FROM k GROUP BY page, group_id""",
}
