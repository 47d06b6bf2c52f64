"""DuckDB twins of the text queries that SQL can express."""

OP2_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, strlen(payload) AS payload_bytes, h, max(page_id) OVER (PARTITION BY payload) AS last,
  list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER)) AS five FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // s) % 32, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""

OP6_SUBSTRING_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
o AS (SELECT r, doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM d),
s AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS key FROM o),
f AS (SELECT key, min(doc_id) AS least FROM s GROUP BY key),
g AS (SELECT DISTINCT r, s.i + k AS i FROM s JOIN f USING (key), range(13) x(k) WHERE least < doc_id),
k AS (SELECT t.r, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept FROM t LEFT JOIN g ON g.r = t.r AND g.i = t.i GROUP BY t.r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP9_SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
o AS (SELECT r, doc_id, b, unnest(range(greatest(octet_length(b) - 49, 0))) AS i FROM d),
s AS (SELECT r, doc_id, i, b[i + 1 : i + 50] AS key FROM o),
f AS (SELECT key, min(doc_id) AS least FROM s GROUP BY key),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM s JOIN f USING (key) WHERE least < doc_id),
n AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
p AS (SELECT r, span, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY r, span),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
m AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(CASE WHEN a > before THEN hex(b[before + 1 : a]) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN m.r IS NULL THEN b WHEN z < octet_length(b) THEN unhex(kept) || b[z + 1 : octet_length(b)] ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN m USING (r)
"""
