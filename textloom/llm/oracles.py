"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from textloom.llm.sharding import PRIME, round_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: SHA-1 in base32: forty hex digits as bits, five at a time.
OP1 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])]), '') AS b
  FROM p),
digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5*i+1]::INT + 8 * b[5*i+2]::INT + 4 * b[5*i+3]::INT + 2 * b[5*i+4]::INT + b[5*i+5]::INT]), '') AS payload_digest
  FROM bits),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM digests)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM kept
"""

#: Links by counting shared shingles, components by walking the links.
OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
each AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS t FROM s),
often AS (SELECT t FROM each GROUP BY t HAVING count(*) > 1),
shared AS (SELECT each.* FROM each SEMI JOIN often USING (t)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.y) AS component_id
FROM s JOIN reach ON s.doc_id = reach.x GROUP BY s.doc_id, len(s.s)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component_id, v.vec_id = p.component_id AS kept
FROM v JOIN parts p ON v.vec_id = p.x LEFT JOIN degree d ON v.vec_id = d.x
"""

#: Rows are numbered in one cell below 100,000 of them, by key, size and checksum; the permutation is walked a round at
#: a time.  The checksum goes byte by byte through a table that is made from the polynomial.
OP4 = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS bytes, list_transform(regexp_extract_all(h, '..'), lambda x: (16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1)::BIGINT) AS l FROM d),
c AS (
  SELECT doc_id, bytes + 1 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], l), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32
  FROM b, tab),
x AS (SELECT *, row_number() OVER (ORDER BY coalesce(doc_id, -1), size, text_crc32) - 1 AS rn, count(*) OVER () AS n FROM c),
w AS (SELECT rn, n, greatest(2, length(bin(n - 1))) AS bits, greatest(1, (length(bin(n - 1)) + 1) // 2) AS half FROM x),
k AS (SELECT {[a for a, _ in round_keys(1)]}::BIGINT[] AS a, {[b for _, b in round_keys(1)]}::BIGINT[] AS b),
walk AS (
  SELECT rn, n, bits - half AS lw, half AS rw, rn >> half AS l, rn & ((1::BIGINT << half) - 1) AS r, 0 AS i FROM w
  UNION ALL
  SELECT rn, n, lw, rw,
    CASE WHEN i % 2 = 0 THEN xor(l, (((f.t * f.t + f.a) % {PRIME}) >> 3) & ((1::BIGINT << lw) - 1)) ELSE l END,
    CASE WHEN i % 2 = 1 THEN xor(r, (((f.t * f.t + f.a) % {PRIME}) >> 3) & ((1::BIGINT << rw) - 1)) ELSE r END,
    i % 6 + 1
  FROM (
    SELECT v.*, a, ((CASE WHEN v.i % 2 = 0 THEN r ELSE l END) % {PRIME} * a + b) % {PRIME} AS t
    FROM (SELECT rn, n, lw, rw, l, r, i % 6 AS i FROM walk WHERE n > 1 AND NOT (i = 6 AND (l << rw) + r < n)) v,
      LATERAL (SELECT k.a[v.i + 1] AS a, k.b[v.i + 1] AS b FROM k)) f),
p AS (SELECT rn, CASE WHEN n > 1 THEN (l << rw) + r ELSE rn END AS p FROM walk WHERE n = 1 OR (i = 6 AND (l << rw) + r < n))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p % 16)::INT AS shard, (p // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM x JOIN p USING (rn)
"""

ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]?|xxxx|\*\*\*\*|redacted"

#: Matches and what lies between them give the places; values are judged by distinct owners and repositories.
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
found AS (
  SELECT id, 0 AS kind, owner, repository, regexp_extract_all(t, '{ASSIGN}', 0) AS m, regexp_split_to_array(t, '{ASSIGN}') AS gaps FROM d
  UNION ALL SELECT id, 1, owner, repository, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT id, 2, owner, repository, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_split_to_array(t, '[0-9a-f]+') FROM d),
each AS (SELECT id, kind, owner, repository, unnest(m) AS m, unnest(gaps[:len(m)]) AS gap, generate_subscripts(m, 1) AS place FROM found WHERE len(m) > 0),
placed AS (
  SELECT id, kind, owner, repository, m, sum(length(gap) + length(m)) OVER (PARTITION BY id, kind ORDER BY place) AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(m, '{ASSIGN}', 1) ELSE m END AS value
  FROM each),
base AS (SELECT id, kind, owner, repository, stop - length(m) AS start, stop, stop - length(value) AS value_start, value FROM placed WHERE length(value) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
classes AS (
  SELECT value, CASE WHEN count(DISTINCT owner) >= 3 OR (count(DISTINCT owner) = 2 AND count(DISTINCT (owner, repository)) >= 5) THEN 4
    WHEN count(DISTINCT owner) = 1 AND length(value) >= 12 AND len(list_distinct(regexp_extract_all(value, '.'))) >= 8 AND NOT regexp_matches(value, '{PLACEHOLDER}') THEN 3 END AS class
  FROM base GROUP BY value),
spans AS (
  SELECT id, kind, start, stop FROM base
  UNION SELECT id, class, value_start, stop FROM base JOIN classes USING (value) WHERE class IS NOT NULL),
told AS (
  SELECT id, kind, start, stop, ['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || start || ':' || stop AS told FROM spans),
sums AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(told, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(told, ',' ORDER BY start, kind, stop) AS spans
  FROM told GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (id)
"""

#: All orders are listed, and each step counts the masks that fail its filter and none before it.
OP11 = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (
  SELECT part, coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, e.f, g.f] AS o FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
steps AS (
  SELECT list_aggregate(list_transform(o, lambda x: 'ABCDE'[x + 1]), 'string_agg', '') AS filter_order, s AS step, (1 << o[s]) AS own,
    coalesce(list_sum(list_transform(o[1:s - 1], lambda x: 1 << x)), 0)::BIGINT AS before
  FROM orders, range(1, 6) r(s)),
told AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""

#: Every anchor against every row.
OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM v a, v e WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

ORACLES = {"op1_warc": OP1, "op4_feistel_shards": OP4, "op5_secrets": OP5, "op8_jaccard_join": OP8, "op10_embedding_join": OP10, "op11_filter_audit": OP11, "op13_hard_negatives": OP13}
