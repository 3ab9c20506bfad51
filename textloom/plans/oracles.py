"""DuckDB SQL with the same rows as the queries of the same name."""

from __future__ import annotations

from textloom.functions.text import STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
PATH = "source || '/' || doc_id || '.txt'"


def words(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def terms(c: str) -> str:
    """Distinct informative words in order of first use."""
    return f"list_filter({words(c)}, lambda w, i: w NOT IN ({STOP}) AND list_position({words(c)}, w) = i)"


#: hits(query_id, doc_id, score): all documents that match a benchmark item.
BM25 = f"""
tok AS (SELECT doc_id, {words("source")} AS path, {words("text")} AS content FROM documents),
len AS (SELECT doc_id, len(path) + len(content) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
q AS (SELECT item_id AS query_id, unnest({terms("text")}) AS term FROM benchmark),
used AS (SELECT DISTINCT term FROM q),
post AS (
  SELECT doc_id, term, sum(w) AS tf FROM (
    SELECT doc_id, unnest(path) AS term, 2.0::DOUBLE AS w FROM tok
    UNION ALL SELECT doc_id, unnest(content), 1.0::DOUBLE FROM tok)
  WHERE term IN (SELECT term FROM used) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (
  SELECT query_id, doc_id, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY ALL)
"""


#: What index_changes leaves.
CHANGED = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'moved/' || source ELSE source END AS source, CASE WHEN doc_id % 10 = 2 THEN 'written anew ' || reverse(text) ELSE text END AS text
  FROM main.documents WHERE doc_id % 10 NOT IN (1, 5)"""


def lexical(k: int, name: str = "lex") -> str:
    return f"""{BM25}, {name} AS (
  SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM hits) WHERE rank <= {k})"""


def knn(queries: str, k: int, name: str = "vec", least: float = 0.0) -> str:
    return f"""{name} AS (
  SELECT query_id, vec_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
      FROM embeddings e, (SELECT * FROM embeddings WHERE {queries}) q))
  WHERE rank <= {k} AND score >= {least})"""


KNOWN = f"known AS (SELECT {PATH} AS rel_path, n_chars AS size_bytes, doc_id * 1000 AS mtime_ns, substr(sha256(text), 1, 16) AS content_hash, doc_id, text FROM documents)"
SEEN = """seen AS (
  SELECT CASE WHEN doc_id % 10 = 2 THEN 'moved/' || doc_id ELSE rel_path END AS rel_path,
    size_bytes + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS size_bytes, mtime_ns + CASE WHEN doc_id % 10 IN (3, 4) THEN 1 ELSE 0 END AS mtime_ns,
    CASE WHEN doc_id % 10 = 4 THEN substr(sha256(text || 'x'), 1, 16) ELSE content_hash END AS content_hash
  FROM known WHERE doc_id % 10 <> 1
  UNION ALL SELECT 'new/' || doc_id, size_bytes, mtime_ns, substr(sha256(text || 'new'), 1, 16) FROM known WHERE doc_id % 10 = 5)"""
PLAN = f"""{KNOWN}, {SEEN},
c AS (
  SELECT coalesce(s.rel_path, k.rel_path) AS rel_path, coalesce(s.content_hash, k.content_hash) AS h,
    CASE WHEN k.rel_path IS NULL THEN 'add' WHEN s.rel_path IS NULL THEN 'delete'
      WHEN s.size_bytes = k.size_bytes AND s.mtime_ns = k.mtime_ns OR s.content_hash = k.content_hash THEN 'unchanged' ELSE 'update' END AS action
  FROM seen s FULL JOIN known k ON s.rel_path = k.rel_path),
moves AS (
  SELECT d.old_path, a.new_path FROM (SELECT h, min(rel_path) AS old_path FROM c WHERE action = 'delete' GROUP BY h HAVING count(*) = 1) d
  JOIN (SELECT h, min(rel_path) AS new_path FROM c WHERE action = 'add' GROUP BY h HAVING count(*) = 1) a USING (h)),
plan AS (
  SELECT action, CASE WHEN action <> 'add' THEN rel_path END AS old_path, CASE WHEN action <> 'delete' THEN rel_path END AS new_path FROM c
  WHERE NOT (action = 'delete' AND rel_path IN (SELECT old_path FROM moves)) AND NOT (action = 'add' AND rel_path IN (SELECT new_path FROM moves))
  UNION ALL SELECT 'move', old_path, new_path FROM moves)"""

CHUNKS = "chunks AS (SELECT 'v' || doc_id AS vector_id, doc_id AS note_id FROM documents WHERE doc_id % 3 <> 0), vectors AS (SELECT 'v' || vec_id AS vector_id FROM embeddings)"
STATES = f"""states AS (SELECT {PATH} AS rel_path, n_chars AS size_bytes,
  CASE WHEN {PATH} = 'src11/11.txt' THEN 'indexing' WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'indexed' ELSE 'pending' END AS status FROM documents)"""
RUNS = "runs AS (SELECT event_id AS run_id, user_id AS vault_id, ['success','failed','running','queued','cancelled'][event_id % 5 + 1] AS status, ts AS started_at FROM events)"
PROFILES = "p AS (SELECT c_custkey AS id, c_nationkey::VARCHAR AS user_id, c_mktsegment AS kind, c_name AS name, c_custkey % 7 = 0 AS is_default, c_custkey % 3 <> 0 AS enabled FROM customer)"
TAGLESS = "regexp_replace({0}, '<[^>]+>', '', 'g')"


def stripped(c: str) -> str:
    out = TAGLESS.format(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


ORACLES = {
    "term_stats": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents) GROUP BY term",
    "query_terms": f"SELECT item_id, nullif(array_to_string({terms('text')}, ' '), '') AS terms FROM benchmark",
    "bm25_topk": f"WITH {lexical(10)} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM lex",
    "bm25_short": f"""WITH {lexical(10).replace(f"unnest({terms('text')}) AS term", f"unnest({terms('text')}[1:3]) AS term")} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM lex""",
    "index_changes": f"WITH documents AS ({CHANGED}), {lexical(5)} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM lex",
    "knn_exact": f"WITH {knn('vec_id % 100 = 0', 10)} SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM vec",
    "knn_threshold": f"WITH {knn('vec_id % 100 = 0', 20, least=0.3)} SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM vec",
    "hybrid_rrf": f"""WITH {lexical(20)}, {knn('vec_id IN (SELECT item_id FROM benchmark)', 20)},
both_ AS (SELECT query_id, doc_id, 0 AS list, rank, score FROM lex UNION ALL SELECT query_id, vec_id, 1, rank, score FROM vec),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fusion_score, coalesce(max(score) FILTER (list = 1), 0) AS score, max(score) FILTER (list = 0) AS bm25_score,
  max(rank) FILTER (list = 1) AS vr, max(rank) FILTER (list = 0) AS br FROM both_ GROUP BY ALL)
SELECT query_id, doc_id, fusion_score, score, bm25_score, vr IS NOT NULL AS vector_recalled, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, vr NULLS LAST, br NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 5""",
    "cross_scope_rrf": f"""WITH {BM25},
s AS (SELECT query_id, lang, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY score, doc_id) AS sr FROM hits JOIN documents USING (doc_id))
SELECT query_id, rank::INTEGER AS rank, lang, doc_id, round(1.0::DOUBLE / (60 + sr), 6) AS fusion_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sr, lang, doc_id) AS rank FROM s WHERE sr <= 5) WHERE rank <= 5""",
    "rerank_local": f"""WITH {lexical(20)},
t AS (SELECT item_id AS query_id, {terms('text')} AS terms FROM benchmark),
s AS (SELECT query_id, doc_id, lex.rank AS pool, round(len(list_intersect(terms, {words('d.text')}))::DOUBLE / len(terms), 6) AS rerank_score FROM lex JOIN t USING (query_id) JOIN documents d USING (doc_id))
SELECT query_id, rank::INTEGER AS rank, doc_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pool) AS rank FROM s) WHERE rank <= 5""",
    "rerank_fallback": f"WITH {lexical(5)} SELECT query_id, doc_id, rank::INTEGER AS rank, NULL::DOUBLE AS rerank_score FROM lex",
    "candidate_pool": f"SELECT conv_id, turn, k, least(greatest(k * 4, 20), 100)::BIGINT AS pool FROM (SELECT conv_id, turn, len({words('text')}) AS k FROM conversations)",
    "context_block": f"""WITH {lexical(3)}
SELECT query_id, string_agg('[' || rank || '] 来源：' || lang || ' · ' || source || '/' || doc_id || '.txt' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM lex JOIN documents USING (doc_id) GROUP BY query_id""",
    "hard_split": """SELECT doc_id, s::INTEGER AS char_start, (s + length(p))::INTEGER AS char_end, p AS text FROM (
  SELECT doc_id, s, substr(text, s::INTEGER + 1, 800) AS p FROM (SELECT doc_id, text, unnest(range(0, length(text), 680)) AS s FROM documents)) WHERE NOT regexp_full_match(p, '\\s*')""",
    "html_text": f"SELECT page_id, trim(regexp_replace({stripped('html')}, '\\s+', ' ', 'g')) AS text FROM pages",
    "html_headings": f"""SELECT page_id, (i - 1)::INTEGER AS place, regexp_extract(h, '(?i)^<h([1-6])', 1)::INTEGER AS level, trim({stripped("regexp_extract(h, '(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$', 1)")}) AS title
FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages))""",
    "breadcrumbs": """WITH h AS (SELECT conv_id, turn, turn * 7 % 5 + 1 AS level, role || turn AS title, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place FROM conversations)
SELECT a.conv_id, a.place, string_agg(b.title, ' > ' ORDER BY b.place) AS crumb FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.place <= a.place
WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.conv_id = a.conv_id AND c.place > b.place AND c.place <= a.place AND c.level <= b.level) GROUP BY a.conv_id, a.place""",
    "image_refs": """WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations), r AS (
  SELECT conv_id, turn, '![a b](<x y.png> "t")' AS raw, 0 AS start, 'a b' AS alt, 'x y.png' AS target, 'md' AS kind FROM t
  UNION ALL SELECT conv_id, turn, '![[b.png#top|300]]', n + 23, '', 'b.png', 'wiki' FROM t
  UNION ALL SELECT conv_id, turn, '![[c.png|alt]]', n + 42, 'alt', 'c.png', 'wiki' FROM t
  UNION ALL SELECT conv_id, turn, '<img src=''d.png''>', n + 57, '', 'd.png', 'html' FROM t)
SELECT conv_id, turn, raw, start::INTEGER AS start, (start + length(raw))::INTEGER AS "end", alt, target, kind FROM r""",
    "image_shell": "SELECT conv_id, turn, turn % 2 = 0 OR trim(text) = '' AS shell FROM conversations",
    "content_hash16": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, 'v1_n' || doc_id || '_c0' AS vector_id FROM documents",
    "image_uid": "SELECT page_id, 'img_' || substr(sha256('u1:' || sha256(url)), 1, 16) AS uid FROM pages",
    "mask_key": """SELECT c_custkey, CASE WHEN length(k) = 0 THEN '' WHEN length(k) <= 8 THEN substr(k, 1, 1) || repeat('*', length(k) - 1) ELSE substr(k, 1, 4) || '****' || right(k, 2) END AS masked
FROM (SELECT c_custkey, substr(c_name, 1, (c_custkey % 19)::INTEGER) AS k FROM customer)""",
    "epoch_ms": "SELECT event_id, epoch_us(ts) // 1000 AS ms, (event_id * 1000003) // 1000000 AS mtime_ms FROM events",
    "glob_filter": f"""SELECT * FROM (SELECT {PATH} AS rel_path, n_chars AS size_bytes FROM documents)
WHERE (regexp_full_match(rel_path, 'src1.*/.*') OR regexp_full_match(rel_path, '.*/.[0-4].*\\.txt')) AND NOT rel_path LIKE 'src3/%' AND NOT rel_path LIKE '%9.txt' AND size_bytes <= 20000""",
    "chunk_formats": "SELECT doc_id, ['markdown', 'html', 'text', 'markdown', 'markdown', 'text'][doc_id % 6 + 1] AS format FROM documents",
    "reconcile_plan": f"WITH {PLAN} SELECT * FROM plan",
    "need_hash": f"WITH {KNOWN}, {SEEN} SELECT s.rel_path FROM seen s LEFT JOIN known k ON s.rel_path = k.rel_path WHERE k.rel_path IS NULL OR s.size_bytes <> k.size_bytes OR s.mtime_ns <> k.mtime_ns",
    "move_pairs": f"WITH {PLAN} SELECT * FROM moves",
    "prune_guard": f"""WITH {PLAN}, n AS (SELECT count(*) FILTER (action = 'add') AS adds, count(*) FILTER (action = 'update') AS updates, count(*) FILTER (action = 'move') AS moves,
  count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (action = 'unchanged') AS unchanged FROM plan)
SELECT *, CASE WHEN deletes > 0.05 * (SELECT count(*) FROM known) THEN 'over_ratio' END AS blocked_reason FROM n""",
    "plan_samples": f"""WITH {PLAN}, r AS (SELECT action, coalesce(new_path, old_path) AS path, row_number() OVER (PARTITION BY action ORDER BY coalesce(new_path, old_path)) AS r FROM plan WHERE action <> 'unchanged')
SELECT action, string_agg(path, ',' ORDER BY path) AS paths FROM r WHERE r <= 10 GROUP BY action""",
    "doctor_ghost": f"WITH {CHUNKS} SELECT vector_id FROM vectors WHERE vector_id NOT IN (SELECT vector_id FROM chunks)",
    "doctor_missing": f"WITH {CHUNKS} SELECT vector_id, note_id FROM chunks WHERE vector_id NOT IN (SELECT vector_id FROM vectors)",
    "doctor_orphan": f"WITH {CHUNKS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT note_id FROM chunks)",
    "doctor_report": f"""WITH {CHUNKS}, n AS (SELECT (SELECT count(*) FROM vectors WHERE vector_id NOT IN (SELECT vector_id FROM chunks)) AS ghosts, (SELECT count(*) FROM chunks WHERE vector_id NOT IN (SELECT vector_id FROM vectors)) AS missing,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT note_id FROM chunks)) AS orphans) SELECT *, ghosts + missing + orphans = 0 AS healthy FROM n""",
    "doctor_repair": f"WITH {CHUNKS} SELECT vector_id FROM vectors WHERE vector_id IN (SELECT vector_id FROM chunks)",
    "file_status_page": f"WITH {STATES} SELECT rel_path, size_bytes, status FROM states WHERE contains(lower(rel_path), 'src1') ORDER BY lower(rel_path), rel_path LIMIT 50 OFFSET 50",
    "file_status_counts": f"WITH {STATES} SELECT count(*) FILTER (status = 'indexing') AS indexing, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'pending') AS pending, count(*) AS total FROM states",
    "browse_dirs": "SELECT source AS name, bool_or(doc_id % 2 = 0) AS has_children FROM documents GROUP BY source",
    "scope_counts": "SELECT source AS vault_id, count(*) AS note_count, count(*) FILTER (n_chars > 1000) AS chunk_count FROM documents GROUP BY source UNION ALL SELECT 'empty', 0, 0",
    "conversation_list": """SELECT conv_id, n AS message_count, CASE WHEN f = '' THEN '新对话' WHEN length(f) > 24 THEN substr(f, 1, 24) || '…' ELSE f END AS title FROM (
  SELECT conv_id, count(*) AS n, trim(regexp_replace(coalesce(min_by(text, turn) FILTER (role = 'user'), ''), '\\s+', ' ', 'g')) AS f FROM conversations GROUP BY conv_id)""",
    "conversation_history10": """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)""",
    "run_retention": f"WITH {RUNS} SELECT run_id, vault_id, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY started_at DESC, run_id DESC) AS r FROM runs) WHERE r <= 20 OR status IN ('queued', 'running')",
    "stale_recovery": f"WITH {RUNS} SELECT vault_id, CASE WHEN status IN ('queued', 'running') THEN 'aborted' ELSE status END AS status, count(*) AS n FROM runs GROUP BY ALL",
    "latest_active": f"WITH {RUNS} SELECT vault_id, run_id, started_at FROM runs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY vault_id ORDER BY started_at DESC, run_id DESC) = 1",
    "run_kpis": f"""WITH {RUNS} SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued,
  count(*) FILTER (status = 'success' AND started_at::DATE = '2024-01-15') AS success_today, count(*) FILTER (status = 'failed' AND started_at::DATE = '2024-01-15') AS failed_today FROM runs""",
    "default_profile": f"WITH {PROFILES} SELECT user_id, kind, id, name FROM p WHERE enabled QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY is_default DESC, id) = 1",
    "exclusive_default": f"WITH {PROFILES}, c AS (SELECT user_id AS u, kind AS k FROM p WHERE id = 42) SELECT id, CASE WHEN user_id = u AND kind = k THEN id = 42 ELSE is_default END AS is_default FROM p, c",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 30 MINUTE AS due_at, count(*) AS changes FROM s GROUP BY user_id, g""",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS from_at, event_type, count(*) AS n FROM events GROUP BY ALL",
}
