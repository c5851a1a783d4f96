"""DuckDB statements of the registered queries that SQL can express."""

from __future__ import annotations

# The checksum's table and its run over the bytes; the ranks and places as in the operator, in one window each.
_SHARDS = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(
    [x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
base AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS key,
    list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc
  FROM documents, crc_table
),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY src ORDER BY key, doc_id, size) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY src))::DOUBLE AS fraction
  FROM base
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, src, key, doc_id, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, xor(crc, 4294967295)::BIGINT AS text_crc32, 'rows' AS law,
  (place * 24 // total)::INTEGER AS shard,
  (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM placed
"""

_WARC = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

_TOP_K = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

# All levels of all trees one after another, then every leaf's siblings by its place.
_MERKLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(
    [x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
encoded AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, text,
    coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-')
      || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
      || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-')
      || coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
      lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS even
  FROM documents, crc_table
),
hashed AS (
  SELECT doc_id, src, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(claim))::VARCHAR || ':' || claim, '-')) AS claimed
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS claim FROM encoded)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY src) AS total
  FROM hashed
),
nodes AS (
  SELECT src, 0 AS level, place, leaf AS digest, total FROM placed
  UNION ALL
  SELECT src, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (total + 2) // 3
  FROM nodes WHERE total > 1 GROUP BY src, level, place // 3, total
),
subroots AS (
  SELECT src, digest AS subroot, row_number() OVER (ORDER BY src) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1
),
tops AS (
  SELECT 0 AS level, place, subroot AS digest, total FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (total + 2) // 3
  FROM tops WHERE total > 1 GROUP BY level, place // 3, total
),
steps AS (
  SELECT a.src, a.level, a.place, [coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), ''),
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '')] AS step
  FROM nodes a JOIN nodes b ON a.src = b.src AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.total > 1 GROUP BY a.src, a.level, a.place
),
top_steps AS (
  SELECT a.level, a.place, [coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), ''),
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '')] AS step
  FROM tops a JOIN tops b ON a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.total > 1 GROUP BY a.level, a.place
),
top_paths AS (
  SELECT s.src, s.subroot, coalesce(list(t.step ORDER BY t.level) FILTER (t.level IS NOT NULL), []) AS path
  FROM subroots s LEFT JOIN top_steps t ON t.place = s.place // (3 ** t.level)::BIGINT GROUP BY s.src, s.subroot
),
paths AS (
  SELECT p.doc_id, p.src, p.place, p.leaf, p.claimed, coalesce(list(s.step ORDER BY s.level) FILTER (s.level IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN steps s ON s.src = p.src AND s.place = p.place // (3 ** s.level)::BIGINT
  GROUP BY p.doc_id, p.src, p.place, p.leaf, p.claimed
),
proven AS (
  SELECT doc_id, leaf, subroot, claimed, (SELECT digest FROM tops WHERE total = 1) AS root, p.path || t.path AS path
  FROM paths p JOIN top_paths t USING (src)
),
checked AS (
  SELECT *, list_reduce([[claimed]] || path, lambda node, s: [sha256(s[1] || node[1] || s[2])])[1] AS folded_root FROM proven
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM checked
"""

ORACLES = {
    "op4_seekable_warc": _WARC,
    "op8_proportional_shards": _SHARDS,
    "op11_columnar_top_k": _TOP_K,
    "op13_merkle_witnesses": _MERKLE,
}
