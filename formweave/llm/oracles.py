"""DuckDB SQL for the queries that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""

OP5 = r"""
WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
p AS (SELECT text, string_split(text, chr(10)) AS parts FROM d),
s AS (SELECT text, unnest(parts) AS line, unnest(range(len(parts))) AS nr FROM p),
l AS (
  SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM s),
known AS (SELECT tokens, count(DISTINCT text) AS docs FROM l WHERE len(tokens) > 0 GROUP BY tokens),
x AS (SELECT tokens, docs, len(tokens) AS n, tokens[1:2] AS lead, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM known),
place AS (SELECT * FROM x WHERE token <> '<*>'),
constant AS (SELECT n, lead, pos, token FROM place GROUP BY ALL HAVING sum(docs) >= 3),
template AS (
  SELECT tokens, n, lead, list({'pos': pos, 'token': token} ORDER BY pos) AS fixed
  FROM place SEMI JOIN constant USING (n, lead, pos, token) GROUP BY tokens, n, lead HAVING 2 * count(*) >= n),
recurring AS (SELECT n, lead, fixed FROM template JOIN l USING (tokens) GROUP BY ALL HAVING count(DISTINCT text) >= 3),
gone AS (SELECT tokens, true AS goes FROM template SEMI JOIN recurring USING (n, lead, fixed)),
clean AS (
  SELECT text, count(*) AS n_lines, count(goes) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE goes IS NULL), '') AS rest
  FROM l LEFT JOIN gone USING (tokens) GROUP BY text)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, rest AS text
FROM documents LEFT JOIN clean USING (text)
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h,
         min(page_id) OVER (PARTITION BY body) AS owner
  FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM b
"""


OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4
           THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS items
  FROM w),
x AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (
  SELECT a, b FROM link
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, len(items) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op5_line_dedup": OP5, "op6_jaccard": OP6, "op7_warc": OP7}
