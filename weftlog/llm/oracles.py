"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2
), l AS (SELECT a, b FROM both_ WHERE 100 * o >= 90 * (na + nb - o)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""

OP8 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
found AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND array_to_string(pos.w[pos.i : pos.i + pos.n - 1], ' ') = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LOW", LOWER)

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top, unhex(sha1(html))::BIT::VARCHAR AS b FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(b, (5 * i + 1)::BIGINT, 1)::INT + 8 * substr(b, (5 * i + 2)::BIGINT, 1)::INT + 4 * substr(b, (5 * i + 3)::BIGINT, 1)::INT + 2 * substr(b, (5 * i + 4)::BIGINT, 1)::INT + substr(b, (5 * i + 5)::BIGINT, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
k AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM w),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM k) WHERE first < doc_id),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM f)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, span),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) + 1, 2 * ((CASE WHEN i > n_spans THEN length(h) // 2 ELSE a[i] END) - (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (3), (5), (7), (10)) v(n) WHERE len(w) >= n),
again AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, array_to_string(w[i : i + n - 1], ' ')) AS k FROM g) WHERE k > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM again),
cover AS (
  SELECT inside.doc_id, count(*) FILTER (WHERE n = 3) AS words, coalesce(sum(length(w.w[p])) FILTER (WHERE n = 5), 0) AS c5,
    coalesce(sum(length(w.w[p])) FILTER (WHERE n = 7), 0) AS c7, coalesce(sum(length(w.w[p])) FILTER (WHERE n = 10), 0) AS c10
  FROM inside JOIN w USING (doc_id) GROUP BY 1
), l AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS later
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE later) AS dup, coalesce(sum(chars) FILTER (WHERE later), 0) AS dup_chars FROM l WHERE chars > 0 GROUP BY 1
), m AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(words, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars,
    coalesce(c5, 0) AS c5, coalesce(c7, 0) AS c7, coalesce(c10, 0) AS c10
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (SELECT *, greatest(word_chars, 1)::DOUBLE AS total, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_dup_lines > 0.5::DOUBLE * n_lines OR dup_chars > 0.3::DOUBLE * total OR n_symbols > 0.25::DOUBLE * n_words OR c5 > 0.4::DOUBLE * total OR c7 > 0.35::DOUBLE * total OR c10 > 0.3::DOUBLE * total) AS kept,
  greatest(c5, c7, c10) / total AS repeat_coverage
FROM b
"""

#: Host, path and rule of every page; the verdicts of pages without a rule are the trees', beyond SQL.
OP10_PLACES = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(domain, prefix) AS (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, max_by(domain || prefix, length(domain || prefix)) FILTER (WHERE domain IS NOT NULL) AS rule
FROM u LEFT JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id
"""
