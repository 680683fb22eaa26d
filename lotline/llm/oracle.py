"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

OP3 = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
places(host_rule, path_rule, rule, verdict) AS (VALUES
  ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
  ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
fits AS (
  SELECT p.host, p.path, arg_max(q.rule, length(q.rule)) AS rule, arg_max(q.verdict, length(q.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN places q
    ON (p.host = q.host_rule OR p.host LIKE '%.' || q.host_rule) AND starts_with(p.path, q.path_rule)
  GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN
         regexp_matches(low, '://[^/?#]*\bcasino\b') OR regexp_matches(low, '://[^/?#]*\b(cheap|buy|discount)[-_.]?pills?\b')
         OR regexp_matches(low, '://[^/?#]*\b(cheap|buy|discount)[-_.]pill\b') OR regexp_matches(low, '://[^/?#]*\b(free|best|live)[-_.]bets?\b')
         OR regexp_matches(low, '://[^/?#]*\b(xxx|porn|adult)\b') OR regexp_matches(low, '\breplica[-_.]?(watch|watches|bags)\b')
         OR regexp_matches(low, '\b(payday|quick|instant)[-_.]loans?\b') OR regexp_matches(low, '\b(crack|keygen|warez)\b.*\bdownload\b')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
left_over AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
  FROM per WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(CAST(rest AS DOUBLE) / CAST(rest_w AS DOUBLE)) OVER () * w) AS target FROM left_over),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
groups AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.whole + CASE WHEN g.upto <= p.target - p.whole * p.source_size
         OR (p.target - p.whole * p.source_size - (g.upto - g.words)) * 2 >= g.words AND g.upto - g.words <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source JOIN groups g ON s.source IS NOT DISTINCT FROM g.source AND s.h = g.h
"""

OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
shown AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

SQL = {"op3_url_filter": OP3, "op4_mixing": OP4, "op10_chat": OP10}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, s FROM (
    SELECT r, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END AS l FROM words WHERE len(w) > 0) x, unnest(l) t(s)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r) p
  JOIN sizes u ON u.r = x JOIN sizes v ON v.r = y WHERE 100 * k >= 80 * (u.n + v.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM words UNION SELECT p.x, e.y FROM reach p JOIN ways e ON p.y = e.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id
FROM words w LEFT JOIN sizes s ON w.r = s.r JOIN (SELECT p.x, min(o.doc_id) AS c FROM reach p JOIN words o ON p.y = o.r GROUP BY p.x) m ON w.r = m.x
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS b, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([3, 2, 1, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(5 * k AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM q
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
tests AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[j:j+n-1], ' ') AS k FROM b, unnest(range(1, len(w) - n + 2)) t(j)),
places AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM d, (SELECT DISTINCT n FROM tests) m, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, i, p.n, item FROM places p JOIN tests t ON p.k = t.k AND p.n = t.n),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
marks AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items i ON d.r = i.r LEFT JOIN marks m ON d.r = m.r
"""

SQL |= {"op6_jaccard": OP6, "op7_warc": OP7, "op9_decontamination": OP9}

OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
bits AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask FROM w),
m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM bits LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l)
  JOIN f d ON d.l NOT IN (a.l, b.l, c.l) JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, step, bs[step] AS b, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS BIGINT) AS before FROM p, unnest([1, 2, 3, 4, 5]) t(step)),
r AS (
  SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & b > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM r
"""

_NEAR = """d{k} AS MATERIALIZED (
  SELECT r, min(d * 8 + c) % 8 AS c, min(d) AS d FROM (
    SELECT v.r, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i]))) AS d FROM v, c{k} c) GROUP BY r)"""
_MEANS = """c{n} AS MATERIALIZED (
  SELECT o.c, coalesce(m.p, o.p) AS p FROM c{k} o LEFT JOIN (
    SELECT c, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS p FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT d.c, unnest(range(1, 65)) AS i, unnest(v.p) AS x FROM v JOIN d{k} d USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))"""

OP13 = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, p FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, p FROM v ORDER BY h LIMIT 8)),
"""
    + ",\n".join(x for k in range(10) for x in (_NEAR.format(k=k), _MEANS.format(k=k, n=k + 1)))
    + ",\n"
    + _NEAR.format(k=10)
    + """
SELECT vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(d.d AS BIGINT) AS distance, CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM v JOIN d10 d USING (r) JOIN c10 c ON c.c = d.c
"""
)

OP11 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) t(i)),
hits AS MATERIALIZED (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
begun AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM hits)),
spans AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 399 AS z FROM begun GROUP BY r, g),
pieces AS (
  SELECT r, a, CAST(coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS BIGINT) + 1 AS f, a - 1 AS u FROM spans
  UNION ALL SELECT r, octet_length(b) + 1, z + 1, octet_length(b) FROM d JOIN (SELECT r, max(z) AS z FROM spans GROUP BY r) USING (r)),
kept AS (SELECT r, unhex(string_agg(CASE WHEN u >= f THEN hex(b[f:u]) ELSE '' END, '' ORDER BY p.a)) AS k FROM pieces p JOIN d USING (r) GROUP BY r),
told AS (SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

SQL |= {"op11_suffix_dedup": OP11}

SQL |= {"op12_filter_audit": OP12, "op13_kd_cluster": OP13}
