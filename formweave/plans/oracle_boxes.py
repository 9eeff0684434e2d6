"""DuckDB SQL for the queries over boxes and worksheets."""

from .oracle_facts import FACTS

LINES = """WITH raw AS (SELECT doc_id AS page, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ord FROM documents),
l AS (SELECT *, CASE WHEN ord % 11 = 0 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, ord % 5 = 0 AS bold, ord // 2 AS block_no, CASE WHEN ord % 3 = 2 THEN 300 ELSE 60 END::DOUBLE AS x0, (40 + 12 * ord + 9 * (ord // 7))::DOUBLE AS y0,
        CASE WHEN ord % 3 = 2 THEN 300 ELSE 60 END + least(220, 5 * length(text))::DOUBLE AS x1, (50 + 12 * ord + 9 * (ord // 7))::DOUBLE AS y1, CASE WHEN ord % 3 = 2 THEN 1 ELSE 0 END AS col FROM raw WHERE trim(text) <> ''),
f AS (SELECT * FROM l)
"""


def overlap(a: str, b: str, axis: str) -> str:
    return f"(greatest(0, least({a}{axis}1, {b}{axis}1) - greatest({a}{axis}0, {b}{axis}0)) / least({a}{axis}1 - {a}{axis}0, {b}{axis}1 - {b}{axis}0))"


_SHEET = """WITH o AS (SELECT o_orderkey AS k, 'r' || (o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS row_id, min(o_orderpriority) AS label FROM orders GROUP BY o_orderkey),
b AS (SELECT 'r' || k AS row_id, k AS bk, k % 5 + 1 AS page, CASE WHEN k % 19 = 0 THEN label || ' changed' ELSE label END AS text, CASE WHEN k % 29 = 0 THEN 'Vital Signs' ELSE 'Medical History' END AS form FROM o WHERE k % 17 <> 0),
s AS (SELECT *, ['MHTERM', 'DSTERM', 'BAD-VAR', 'AGE', ''][k % 5 + 1] AS v, ['', 'VARIABLE', 'NOTE', 'ODD'][k % 4 + 1] AS t, upper(['APPROVED', 'REJECTED', 'AUTO', '', 'approved', 'DONE'][k % 6 + 1]) AS st, k % 4 = 0 AS noted,
        k % 4 IN (0, 3) AS has_color, k % 4 = 1 AS bad_color, ['8.0', '30', 'big', ''][k % 4 + 1] AS size, ['right_of_field', 'nowhere', ''][k % 3 + 1] AS place, row_number() OVER (PARTITION BY row_id ORDER BY k) AS nth FROM o),
g AS (SELECT row_id, max(k) AS k FROM s WHERE k % 13 <> 0 GROUP BY 1),
c AS (SELECT s.*, g.k AS gk, b.bk, b.page, b.form, list_filter([
  CASE WHEN nth > 1 THEN 'DUPLICATE_ROW_ID' END, CASE WHEN nth = 1 AND b.row_id IS NULL THEN 'UNKNOWN_ROW_ID' END, CASE WHEN nth = 1 AND lower(s.label) <> lower(b.text) THEN 'ROW_ALTERED' END,
  CASE WHEN nth = 1 AND lower(s.label) = lower(b.text) AND b.form <> 'Medical History' THEN 'FORM_RENAMED' END,
  CASE WHEN v = '' AND s.k % 10 = 4 THEN 'UNEVALUATED_FORMULA' END, CASE WHEN st = '' AND s.k % 4 = 0 THEN 'UNEVALUATED_FORMULA' END,
  CASE WHEN st = '' THEN 'MISSING_STATUS' WHEN st = 'DONE' THEN 'BAD_STATUS' WHEN st = 'AUTO' THEN 'NOT_REVIEWED' END, CASE WHEN st = 'REJECTED' AND NOT noted THEN 'NO_REJECT_REASON' END,
  CASE WHEN st = 'APPROVED' AND v = '' THEN 'MISSING_DECISION' END, CASE WHEN v = 'BAD-VAR' THEN 'BAD_VARIABLE' END, CASE WHEN v <> '' AND t = 'ODD' THEN 'BAD_ANNOT_TYPE' END,
  CASE WHEN v IN ('MHTERM', 'DSTERM', 'AGE') AND t = 'NOTE' THEN 'TYPE_MISMATCH' END, CASE WHEN v = 'DSTERM' THEN 'DOMAIN_MISMATCH' END, CASE WHEN bad_color THEN 'BAD_COLOR' END,
  CASE WHEN size IN ('big', '30') THEN 'BAD_FONT_SIZE' END, CASE WHEN place = 'nowhere' THEN 'BAD_PLACEMENT' END, CASE WHEN st = 'APPROVED' AND NOT has_color THEN 'MISSING_COLOR' END, CASE WHEN g.k IS NULL THEN 'MISSING_GEOMETRY' END,
  CASE WHEN g.k % 23 > 20 THEN 'BAD_GEOMETRY' END], lambda x: x IS NOT NULL) AS codes FROM s LEFT JOIN g USING (row_id) LEFT JOIN b USING (row_id)),
e AS (SELECT *, len(list_filter(codes, lambda x: x NOT IN ('NOT_REVIEWED', 'NO_REJECT_REASON', 'TYPE_MISMATCH', 'DOMAIN_MISMATCH', 'FORM_RENAMED'))) = 0 AS ok FROM c),
r AS (SELECT *, CASE WHEN ok AND st = 'APPROVED' THEN 'HUMAN_APPROVED' WHEN st = 'REJECTED' THEN 'HUMAN_REJECTED' END AS trust, CASE WHEN size = '8.0' OR size = '30' THEN size::DOUBLE ELSE 8 END AS pt,
        CASE WHEN gk IS NULL OR gk % 23 > 20 THEN 0 ELSE gk % 5 / 100 END AS dx, CASE WHEN gk IS NULL OR gk % 23 > 20 THEN 0 ELSE gk % 7 / 100 END AS dy, bk % 60 * 10 AS y0 FROM e WHERE bk IS NOT NULL AND ((ok AND st = 'APPROVED') OR st = 'REJECTED')),
m AS (SELECT *, CASE WHEN trust = 'HUMAN_APPROVED' THEN v ELSE 'MHTERM' END AS drawn FROM r)
"""
SQL = {
    "repeated_lines": LINES + r""", k AS (SELECT lang, page, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS line_text, round_even((y0 + y1) / 6, 0)::BIGINT AS line_y FROM l),
n AS (SELECT lang, count(*) AS total FROM documents GROUP BY 1)
SELECT k.lang, line_text, line_y, count(DISTINCT page) AS on_pages FROM k JOIN n ON k.lang = n.lang WHERE total >= 3 GROUP BY k.lang, line_text, line_y, total HAVING count(DISTINCT page) >= greatest(3, floor(total * 0.01))""",
    "region_tagging": LINES + "SELECT page, CASE WHEN (y0 + y1) / 2 < CASE WHEN page % 3 = 0 THEN 101 ELSE 842 * 0.08::DOUBLE END THEN 'HEADER' WHEN (y0 + y1) / 2 > CASE WHEN page % 4 = 0 THEN 760 ELSE 842 * 0.92::DOUBLE END THEN 'FOOTER' ELSE 'BODY' END AS region, count(*) AS n FROM l GROUP BY ALL",
    "markup_semi_join": LINES + """SELECT a.page, a.ord, EXISTS (SELECT 1 FROM f b WHERE b.page = a.page AND b.ord % 4 = 1 AND greatest(0, least(a.x1, b.x1 + 10) - greatest(a.x0, b.x0 + 10)) * greatest(0, least(a.y1, b.y1 + 2) - greatest(a.y0, b.y0 + 2)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.6) AS from_annotation FROM f a""",
    "link_candidates": LINES + """, a AS (SELECT page, ord, x0 + 120 AS x0, x1 + 120 AS x1, y0 + 8 AS y0, y1 + 8 AS y1 FROM f WHERE ord % 3 = 1),
p AS (SELECT a.page, 'a' || a.ord AS annotation_id, 'f' || f.ord AS field_id, greatest(0, least(a.y1, f.y1) - greatest(a.y0, f.y0)) / least(a.y1 - a.y0, f.y1 - f.y0) AS row, greatest(f.y0 - a.y1, a.y0 - f.y1) AS gap, a.x0 >= f.x1 AS r, a.ord % 5 = 1 AS agrees,
        greatest(0, 1 - abs((a.y0 + a.y1) / 2 - (f.y0 + f.y1) / 2) / 40) AS near, CASE WHEN a.x1 <= a.x0 THEN true ELSE greatest(0, least(a.x1, 595) - greatest(a.x0, 300)) / (a.x1 - a.x0) >= 0.3 END AS zone
      FROM a JOIN f ON a.page = f.page AND f.ord % 2 = 0),
s AS (SELECT *, least(1, CASE WHEN row > 0 THEN 0.45 * row ELSE 0.45 * 0.25 END + CASE WHEN r THEN 0.15 ELSE 0 END + CASE WHEN agrees THEN 0.15 ELSE 0 END + 0.15 * near + CASE WHEN zone THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM p WHERE row > 0 OR gap <= 6)
SELECT page, annotation_id, field_id, round(score, 6) AS score FROM s WHERE score >= 0.35""",
    "section_asof": LINES + ", h AS (SELECT * FROM f WHERE ord % 7 = 0) SELECT a.page, a.ord, md5(coalesce((SELECT max_by(h.text, h.y0) FROM h WHERE h.page = a.page AND h.y1 <= a.y0), '')) AS section_md5 FROM f a",
    "controls_anti": LINES + f""", c AS (SELECT page, ord, x0 + 230 AS x0, x1 + 230 AS x1, y0 + 1 AS y0, y1 + 1 AS y1, CASE WHEN ord % 2 = 0 THEN 'BOX' ELSE 'CIRCLE' END AS kind FROM f WHERE ord % 3 = 0),
k AS (SELECT g.page, g.ord, c.kind FROM f g JOIN c ON c.page = g.page AND {overlap('c.', 'g.', 'y')} >= 0.5 AND c.x1 >= g.x0
      WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.page = g.page AND o.ord <> g.ord AND {overlap('o.', 'g.', 'y')} >= 0.5 AND o.x0 >= g.x1 AND o.x0 < c.x0))
SELECT g.page, g.ord, coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM k WHERE k.page = g.page AND k.ord = g.ord), '') AS kinds FROM f g""",
    "option_owner": LINES + f""", r AS (SELECT o.page, o.ord, q.ord AS owner, {overlap('o.', 'q.', 'y')} AS v, q.y0 FROM f o JOIN f q ON o.page = q.page AND o.ord % 3 = 2 AND q.ord % 3 = 0 AND o.col <> q.col WHERE {overlap('o.', 'q.', 'y')} >= 0.5 OR q.y0 <= (o.y0 + o.y1) / 2 + 4)
SELECT page, ord, owner FROM r QUALIFY row_number() OVER (PARTITION BY page, ord ORDER BY v >= 0.5 DESC, CASE WHEN v >= 0.5 THEN v ELSE y0 END DESC, owner) = 1""",
    "validate_rows": _SHEET + "SELECT k AS ord, ok, ok AND st = 'APPROVED' AS ready, array_to_string(codes, ',') AS codes FROM e",
    "import_report": _SHEET + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM e) GROUP BY 1",
    "import_totals": _SHEET + """, i AS (SELECT unnest(codes) AS code FROM e UNION ALL SELECT 'MISSING_ROW' FROM b WHERE row_id NOT IN (SELECT row_id FROM o))
SELECT (SELECT count(*) FROM e) AS rows, (SELECT count(*) FROM e WHERE ok AND st = 'APPROVED') AS approved, (SELECT count(*) FROM e WHERE NOT ok) AS blocked,
       count(*) FILTER (code NOT IN ('NOT_REVIEWED', 'NO_REJECT_REASON', 'TYPE_MISMATCH', 'DOMAIN_MISMATCH', 'FORM_RENAMED')) AS errors, count(*) FILTER (code IN ('NOT_REVIEWED', 'NO_REJECT_REASON', 'TYPE_MISMATCH', 'DOMAIN_MISMATCH', 'FORM_RENAMED')) AS warnings FROM i""",
    "missing_sheets": """SELECT 'Annotations' AS "column", 'ERROR' AS severity, 'MISSING_SHEET' AS code""",
    "review_copy": _SHEET + ", l AS (SELECT row_id, arg_max({'n': len(codes), 'ok': ok}, k) AS last FROM e GROUP BY row_id) SELECT k AS ord, last.n::INT AS parts, last.n = 0 AS clean, NOT last.ok AS blocked FROM e JOIN l USING (row_id)",
    "learned_annotations": _SHEET + """SELECT 'p' || page || 'r' || row_id AS annotation_id, drawn AS text, CASE WHEN t <> '' THEN t WHEN v = 'BAD-VAR' THEN 'NOTE' ELSE 'VARIABLE' END AS annot_type, drawn AS variable, 'Medical History' AS form_name,
  round_even(160 + dx * 595, 2) AS x0, round_even(y0 + 5 + dy * 842 - pt, 2) AS y0, round_even(160 + dx * 595 + length(drawn) * pt * 0.55, 2) AS x1, round_even(y0 + 5 + dy * 842 + pt, 2) AS y1 FROM m""",
    "learned_links": _SHEET + "SELECT 'reviewed' AS doc_id, page::INT AS page, row_id AS field_id, 1.0::DOUBLE AS link_score, trust, trust = 'HUMAN_REJECTED' AS rejected FROM m",
    "learned_fields": _SHEET + "SELECT 'reviewed' AS doc_id, CASE WHEN row_id IN (SELECT row_id FROM m) THEN 'Medical History' ELSE form END AS form_name, count(*) AS n FROM b GROUP BY ALL",
    "write_reasons": _SHEET + """, w AS (SELECT CASE WHEN NOT ok THEN 'has errors' WHEN st <> 'APPROVED' THEN 'left at ' || CASE WHEN st = '' THEN 'blank' ELSE st END || ', so not drawn' WHEN gk % 9 NOT BETWEEN 1 AND 5 THEN 'page ' || (gk % 9) || ' does not exist' END AS reason FROM e)
SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY reason""",
    "placement_anchored": """WITH k AS (
  SELECT p_partkey AS row_id, CASE WHEN p_size % 3 > 0 THEN p_size % 3 * 4 ELSE 8 END AS pt, length(p_brand) AS n, p_partkey % 6 AS pl, p_partkey % 5 AS f, p_partkey % 20 / 20 * 595 AS x, p_size % 50 / 50 * 842 AS y, p_partkey % 4 / 100 * 595 AS dx, p_partkey % 3 / 100 * 842 AS dy FROM part),
s AS (SELECT *, n * pt * 0.55::DOUBLE + 8 AS w, pt * 1.35::DOUBLE + 4 AS h, x - 29.75 AS fx0, x + 29.75 AS fx1, y - 8.42 AS fy0, y + 8.42 AS fy1 FROM k),
p AS (SELECT *, CASE pl WHEN 1 THEN fx0 - abs(dx) - w WHEN 2 THEN fx0 WHEN 3 THEN fx0 WHEN 4 THEN x - w / 2 ELSE fx1 + dx END AS px, CASE pl WHEN 2 THEN fy0 - abs(dy) - h / 2 WHEN 3 THEN fy1 + abs(dy) + h / 2 WHEN 4 THEN y ELSE y + dy END AS py FROM s),
c AS (SELECT *, px AS ox0, px + w AS ox1, py - h / 2 AS oy0, py + h / 2 AS oy1 FROM p),
d AS (SELECT *, greatest(0, ox1 - 593) AS l, greatest(0, oy1 - 840) AS u FROM c), e AS (SELECT *, ox0 - l AS x0, ox1 - l AS x1, oy0 - u AS y0, oy1 - u AS y1 FROM d)
SELECT row_id, round_even(CASE WHEN x0 < 2 THEN 2 ELSE x0 END, 2)::DOUBLE AS x0, round_even(CASE WHEN y0 < 2 THEN 2 ELSE y0 END, 2)::DOUBLE AS y0, round_even(CASE WHEN x0 < 2 THEN greatest(3, least(x1 + 2 - x0, 593)) ELSE x1 END, 2)::DOUBLE AS x1,
  round_even(CASE WHEN y0 < 2 THEN y1 + 2 - y0 ELSE y1 END, 2)::DOUBLE AS y1, ((l > 0)::INT + (x0 < 2)::INT + (u > 0)::INT + (y0 < 2)::INT + (f = 2)::INT) AS notes, ['helv', 'hebo', 'helv', 'helv', 'tiro'][f + 1] AS font FROM e""",
    "missing_rows": _SHEET + "SELECT 'r' || k AS row_id, 'MISSING_ROW' AS code FROM o WHERE 'r' || k NOT IN (SELECT row_id FROM o)",
    "upsert_replace": FACTS + "SELECT file_name AS path, count(*) AS n, min(CASE WHEN regexp_matches(file_name, '[05]$') THEN 'NEW' || variable ELSE variable END) AS first_variable FROM facts GROUP BY 1",
    "placement_clamp": """WITH b AS (SELECT p_partkey AS id, (p_size * 14 - 40)::DOUBLE AS a0, (p_partkey % 90 * 10 - 20)::DOUBLE AS b0, (p_size * 14 - 40 + p_partkey % 7 * 100 + 30)::DOUBLE AS a1, (p_partkey % 90 * 10 - 5)::DOUBLE AS b1 FROM part),
s AS (SELECT id, greatest(0, a1 - 593) AS l, a0 - greatest(0, a1 - 593) AS x0, a1 - greatest(0, a1 - 593) AS x1, greatest(0, b1 - 840) AS u, b0 - greatest(0, b1 - 840) AS y0, b1 - greatest(0, b1 - 840) AS y1 FROM b)
SELECT id, CASE WHEN x0 < 2 THEN 2 ELSE x0 END::DOUBLE AS x0, CASE WHEN y0 < 2 THEN 2 ELSE y0 END::DOUBLE AS y0, CASE WHEN x0 < 2 THEN greatest(3, least(x1 + 2 - x0, 593)) ELSE x1 END::DOUBLE AS x1, CASE WHEN y0 < 2 THEN y1 + 2 - y0 ELSE y1 END::DOUBLE AS y1,
       ((l > 0)::INT + (x0 < 2)::INT + (u > 0)::INT + (y0 < 2)::INT) AS notes FROM s""",
}
PAIRS = SQL["link_candidates"].replace("WITH raw", "WITH RECURSIVE raw", 1).replace("SELECT page, annotation_id, field_id, round(score, 6) AS score FROM s WHERE score >= 0.35", """,
r AS (SELECT page, annotation_id, field_id, score, 's' || field_id || CASE WHEN substr(annotation_id, 2)::INT % 2 = 0 THEN 'VARIABLE' ELSE 'NOTE' END AS slot, row_number() OVER (PARTITION BY page ORDER BY score DESC, annotation_id, field_id) AS k FROM s WHERE score >= 0.35),
walk AS (
  SELECT page, 0::BIGINT AS k, ''::VARCHAR AS annotation_id, ''::VARCHAR AS field_id, 0.0::DOUBLE AS score, false AS rejected, []::VARCHAR[] AS claims FROM (SELECT DISTINCT page FROM r)
  UNION ALL
  SELECT r.page, r.k, r.annotation_id, r.field_id, r.score, list_has_any(claims, [r.annotation_id, slot]), CASE WHEN list_has_any(claims, [r.annotation_id, slot]) THEN claims ELSE list_concat(claims, [r.annotation_id, slot]) END
  FROM walk w JOIN r ON r.page = w.page AND r.k = w.k + 1),
links AS (SELECT page, annotation_id, field_id, round_even(score, 3) AS link_score, rejected FROM walk WHERE k > 0)
""")
SQL["link_assignment"] = PAIRS + "SELECT page, annotation_id, field_id, link_score, rejected FROM links"
SQL["unlinked_markup"] = PAIRS + "SELECT page, 'a' || ord AS annotation_id FROM a WHERE NOT EXISTS (SELECT 1 FROM links k WHERE NOT rejected AND k.page = a.page AND k.annotation_id = 'a' || a.ord)"
SQL["links_summary"] = PAIRS + "SELECT count(*) FILTER (NOT rejected) AS links, count(*) AS candidates_scored, coalesce(round_even(avg(link_score) FILTER (NOT rejected), 3), 0) AS mean_link_score FROM links"
SQL["links_of_field"] = PAIRS + "SELECT page, annotation_id, link_score FROM links WHERE NOT rejected AND field_id = 'f2'"
SQL["unlinked_fields"] = PAIRS + "SELECT page, 'f' || ord AS field_id FROM l WHERE ord % 2 = 0 AND 'f' || ord NOT IN (SELECT field_id FROM links WHERE NOT rejected AND links.page = l.page)"
SQL["collision_nudge"] = """WITH RECURSIVE o AS (SELECT DISTINCT o_orderkey AS k FROM orders),
b AS (SELECT k // 20 AS page, 'r' || k AS row_id, (k % 5 * 40)::DOUBLE AS x, (k % 11 * 30)::DOUBLE AS y, row_number() OVER (PARTITION BY k // 20 ORDER BY k % 11, 'r' || k) AS i FROM o),
walk AS (
  SELECT page, 1::BIGINT AS i, NULL::DOUBLE AS at, []::STRUCT(row_id VARCHAR, x DOUBLE, y DOUBLE, moves INT)[] AS placed FROM (SELECT DISTINCT page FROM b)
  UNION ALL
  SELECT page, CASE WHEN hit IS NULL THEN i + 1 ELSE i END, CASE WHEN hit IS NULL THEN NULL ELSE hit.y + 22 END,
         CASE WHEN hit IS NULL THEN list_append(placed, {'row_id': row_id, 'x': x, 'y': CASE WHEN here > y THEN greatest(2, least(here, 820)) ELSE here END, 'moves': (here > y)::INT}) ELSE placed END
  FROM (SELECT w.page, w.i, w.placed, b.row_id, b.x, b.y, coalesce(w.at, b.y) AS here, list_filter(w.placed, lambda p: abs(p.x - b.x) < 60 AND abs(p.y - coalesce(w.at, b.y)) < 20)[1] AS hit FROM walk w JOIN b ON b.page = w.page AND b.i = w.i)),
done AS (SELECT page, placed FROM walk QUALIFY row_number() OVER (PARTITION BY page ORDER BY i DESC) = 1)
SELECT page, p.row_id AS row_id, p.x AS x0, p.y AS y0, p.moves AS moves FROM (SELECT page, unnest(placed) AS p FROM done)"""
SQL["detect_columns"] = LINES.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, q AS (SELECT page, ord, CASE ord % 3 WHEN 0 THEN 60 WHEN 1 THEN 250 ELSE 430 END::DOUBLE AS x0, CASE ord % 3 WHEN 0 THEN 60 WHEN 1 THEN 250 ELSE 430 END + least(150, x1 - x0)::DOUBLE AS x1, y0, y1 FROM l),
walk AS (
  SELECT page, 0::DOUBLE AS lo, 595::DOUBLE AS hi, 0 AS depth, list({'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1} ORDER BY x0, x1) AS s, false AS done FROM q GROUP BY page
  UNION ALL
  SELECT page, part.lo, part.hi, depth + 1, part.s, part.done FROM (
    SELECT page, depth, unnest(CASE WHEN ok THEN [{'lo': lo, 'hi': g0, 's': l, 'done': depth + 1 >= 6}, {'lo': g1, 'hi': hi, 's': r, 'done': depth + 1 >= 6}] ELSE [{'lo': lo, 'hi': hi, 's': s, 'done': true}] END) AS part FROM (
      SELECT *, coalesce(len(l) >= 2 AND len(r) >= 2 AND len(list_filter(s, lambda b: len(list_filter(CASE WHEN (b.x0 + b.x1) / 2 <= g0 THEN r ELSE l END, lambda o: greatest(0, least(b.y1, o.y1) - greatest(b.y0, o.y0)) / least(b.y1 - b.y0, o.y1 - o.y0) >= 0.3)) > 0)) / len(s) >= 0.6, false) AS ok FROM (
        SELECT *, list_filter(s, lambda b: (b.x0 + b.x1) / 2 <= g0) AS l, list_filter(s, lambda b: (b.x0 + b.x1) / 2 >= g1) AS r FROM (
          SELECT *, gap.a AS g0, gap.b AS g1 FROM (
            SELECT *, list_filter(gaps, lambda x: x.b - x.a = list_max(list_transform(gaps, lambda z: z.b - z.a)))[1] AS gap FROM (
              SELECT *, list_filter(list_transform(range(2, len(s) + 1), lambda i: {'a': list_max(list_transform(s[1:i - 1], lambda z: z.x1)), 'b': s[i].x0}), lambda x: x.b - x.a >= 12) AS gaps FROM walk WHERE NOT done AND len(s) >= 2))))))),
bands AS (SELECT page, lo, hi FROM walk WHERE done OR len(s) < 2 UNION ALL SELECT doc_id, 0, 595 FROM documents WHERE doc_id NOT IN (SELECT page FROM q)),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY lo) - 1 AS index, count(*) OVER (PARTITION BY page) AS n FROM bands),
c AS (SELECT page, x1 + 15 AS x0, x1 + 27 AS x1 FROM l WHERE ord % 4 = 0)
SELECT page, index::INT AS index, round(lo, 2) AS x0, round(hi, 2) AS x1, CASE WHEN n < 2 THEN 'UNKNOWN' WHEN n = 2 THEN CASE WHEN index = 0 THEN 'QUESTION_ZONE' ELSE 'RESPONSE_ZONE' END
  WHEN (SELECT count(*) FROM c WHERE c.page = n.page AND greatest(0, least(c.x1, hi) - greatest(c.x0, lo)) / 12 >= 0.5) >= 2 THEN 'RESPONSE_ZONE' ELSE 'UNKNOWN' END AS role_hint FROM n"""
