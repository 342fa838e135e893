"""DuckDB oracles of the training-data operators that SQL can express."""

OP7_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100
"""

OP1_SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d))),
marked AS (
  SELECT w.doc_id, w.i, w.word,
         coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN windows v ON v.doc_id = w.doc_id AND v.i = w.i)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(m.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
                  FROM marked GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

OP4_NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1),
shared AS (SELECT s.* FROM s JOIN often USING (shingle)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shared a JOIN shared b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b, k = na.n AND k = nb.n AS same FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 85 * (na.n + nb.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT l.b, r.root FROM reach r JOIN sides l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, coalesce(c.class_id, d.doc_id) AS class_id,
       CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM sides GROUP BY a) l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT b AS doc_id, min(a) AS class_id FROM links WHERE same GROUP BY b) c ON c.doc_id = d.doc_id
"""

OP11_FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
masks AS (
  SELECT doc_id, part,
         CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before
  FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS i FROM orders)),
here AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM here
"""
