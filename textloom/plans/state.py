"""Queries over stored state and small functions, each with its SQL beside it.

``documents`` stand for notes (``source`` is the vault and its owner, and the
document's id the note's), ``customer`` for profiles, keys and vaults, ``events``
for runs, ``conversations`` for messages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import paths, text
from textloom.operators import fuse, images, maintain, reconcile, records
from textloom.plans.oracles import PLAN
from textloom.plans.queries import PATH, _plan, _runs, _seen, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def notes(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id as id", "source as user_id", "source as vault_id", f"{PATH} as file_path", "n_chars as size_bytes", "doc_id * 1000 as mtime_ns", "substring(sha2(text, 256), 1, 16) as content_hash")


NOTES = "notes AS (SELECT doc_id AS id, source AS vault_id, source || '/' || doc_id || '.txt' AS file_path, n_chars AS size_bytes, doc_id * 1000 AS mtime_ns, substr(sha256(text), 1, 16) AS content_hash FROM documents)"


def chunks(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id as note_id", "source as vault_id", "explode(sequence(0, cast(doc_id % 3 as int))) as idx").withColumn("vector_id", F.concat_ws("_", "note_id", "idx"))


CHUNKS = "chunks AS (SELECT doc_id AS note_id, source AS vault_id, unnest(range(0, doc_id % 3 + 1)) AS idx FROM documents)"


def keys(spark, d):
    used = "timestamp_seconds(1700000000 + c_custkey * 7 % 120)"
    return table(spark, d, "customer").selectExpr("c_custkey as id", "c_name as key_hash", f"if(c_custkey % 5 = 0, null, {used}) as last_used_at", f"if(c_custkey % 3 = 0, {used}, null) as revoked_at")


def vaults(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_nationkey as string) as user_id", "if(c_custkey % 4 = 0, null, cast(c_custkey % 6 as int)) as embed_profile_id", "if(c_custkey % 7 = 0, null, array(cast(c_custkey % 5 as int), 3)) as embed_indexed_profiles", "if(c_custkey % 3 = 0, null, timestamp_seconds(c_custkey)) as indexed_at")


VAULTS = "vaults AS (SELECT c_custkey AS id, c_nationkey::VARCHAR AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END AS embed_profile_id, CASE WHEN c_custkey % 7 <> 0 THEN [c_custkey % 5, 3] END AS indexed, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS indexed_at FROM customer)"


def profiles(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_nationkey as string) as user_id", "if(c_custkey % 2 = 0, 'llm', 'embed') as kind", "c_name as name", "c_name as api_key", "c_custkey % 7 = 0 as is_default", "c_custkey % 3 <> 0 as enabled", "map('multimodal', if(c_custkey % 5 < 2, 'true', 'false')) as params")


PROFILES = "profiles AS (SELECT c_custkey AS id, c_nationkey::VARCHAR AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'llm' ELSE 'embed' END AS kind, c_name AS name, c_custkey % 7 = 0 AS is_default, c_custkey % 3 <> 0 AS enabled, c_custkey % 5 < 2 AS multimodal FROM customer)"
RUN_STATUS = "['success','failed','running','queued','cancelled'][event_id % 5 + 1]"


# ------------------------------------------------------------------ lookups


@query("SELECT doc_id AS id FROM documents WHERE source = 'src11'")
def tenant_read(spark, d):
    """One owner's rows, whatever is asked."""
    return records.Tenant("src11", notes=notes(spark, d)).notes.select("id")


@query(f"WITH {CHUNKS} SELECT count(*) AS n FROM chunks WHERE vault_id NOT IN ('src11', 'src12')")
def clear_vaults(spark, d):
    """Chunks that stay when two vaults are cleared."""
    v = table(spark, d, "documents").selectExpr("source as id", "'u' as user_id").distinct()
    gone = v.where("id in ('src11', 'src12')")
    out = maintain.clear_vaults({"vaults": v, "notes": notes(spark, d), "chunks": chunks(spark, d), "vectors": chunks(spark, d)}, gone, "u")
    return out["chunks"].agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0")
def active_keys(spark, d):
    return records.active_keys(keys(spark, d)).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 4 THEN 1800000000 WHEN c_custkey % 3 = 0 THEN 1700000000 + c_custkey * 7 % 120 END AS revoked FROM customer")
def revoke_key(spark, d):
    out = maintain.revoke_key(maintain.revoke_key(keys(spark, d), 4, F.timestamp_seconds(F.lit(1800000000))), 3, F.timestamp_seconds(F.lit(1800000000)))
    return out.select("id", F.unix_seconds("revoked_at").alias("revoked"))


@query("""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN 1700000000 + c_custkey * 7 % 120 END AS used, c_custkey % 3 = 0 AS gone FROM customer)
SELECT id, CASE WHEN id = 10 AND NOT gone AND (used IS NULL OR 1700000100 - used >= 60) THEN 1700000100 ELSE used END AS used FROM k""")
def touch_key(spark, d):
    return maintain.touch_key(keys(spark, d), "Customer#000000010", F.timestamp_seconds(F.lit(1700000100))).select("id", F.unix_seconds("last_used_at").alias("used"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 17")
def point_lookup(spark, d):
    return records.only(profiles(spark, d), F.col("id") == 17).select("id", "name")


# ---------------------------------------------------------------- functions


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.\\' || source || '\\a//' || doc_id WHEN 1 THEN source || '/../x' WHEN 2 THEN './/' || doc_id ELSE source || '/..b/.' END AS p FROM documents),
s AS (SELECT doc_id, list_filter(string_split(replace(p, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.') AS s FROM p)
SELECT doc_id, CASE WHEN NOT list_contains(s, '..') THEN array_to_string(s, '/') END AS path FROM s""")
def normalize_path(spark, d):
    docs = table(spark, d, "documents")
    p = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(".\\"), "source", F.lit("\\a//"), "doc_id")).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("/../x"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(".//"), "doc_id")).otherwise(F.concat("source", F.lit("/..b/.")))
    return docs.select("doc_id", paths.normalize_path(p).alias("path"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '~~~' || chr(10) || role || '```' || chr(10) || '~~~' ELSE '```' || chr(10) || role || chr(10) || '```' END AS block FROM conversations")
def fence_block(spark, d):
    body = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("```"))).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.fence(body).alias("block"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END AS uid FROM documents")
def parse_images(spark, d):
    j = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"uid":"u'), "doc_id", F.lit('"},null,{"ref":"x"}]'))).when(F.col("doc_id") % 3 == 1, "not json")
    found = text.parse_images(j)
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.get(found, 0)["uid"].alias("uid"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE 0 END AS total FROM documents")
def parse_int_list(spark, d):
    j = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), "doc_id", F.lit(",1]"))).when(F.col("doc_id") % 3 == 1, '{"a":1}')
    return table(spark, d, "documents").select("doc_id", F.aggregate(text.parse_int_list(j), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE '' END AS mime, CASE WHEN doc_id % 2 = 0 THEN sha256(coalesce(source, '')) END AS h FROM documents")
def data_url(spark, d):
    u = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.coalesce("source", F.lit("")), "UTF-8")))).otherwise(F.lit("data:text/plain,abc"))
    x = text.data_url(u)
    return table(spark, d, "documents").select("doc_id", x["mime"].alias("mime"), F.sha2(x["bytes"], 256).alias("h"))


@query("SELECT event_id, date_diff('millisecond', date_trunc('millisecond', ts), TIMESTAMP '2024-02-01') AS ms FROM events")
def elapsed_ms(spark, d):
    return table(spark, d, "events").select("event_id", text.elapsed_ms(F.col("ts"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("ms"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS ago,
least(100, round(event_id % 90 * 100 / 80.0))::INT AS pct FROM (SELECT *, 1706745600 - floor(epoch(ts))::BIGINT AS s FROM events)""")
def progress_words(spark, d):
    now = F.timestamp_seconds(F.lit(1706745600))
    return table(spark, d, "events").select("event_id", paths.relative_time(F.col("ts"), now).alias("ago"), paths.percent(F.col("event_id") % 90, F.lit(80)).alias("pct"))


@query("SELECT vec_id, round(vec_id / 7.0, 4)::DOUBLE AS score, round(vec_id / 7.0, 6)::DOUBLE AS fusion_score, least(greatest(vec_id, 1), 50) AS k FROM embeddings")
def tool_rounding(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") / 7).alias("score"), (F.col("vec_id") / 7).alias("fusion_score"), fuse.tool_k(F.col("vec_id")).alias("k"))
    return fuse.tool_scores(rows)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'v' || vec_id ELSE vec_id || ':d' || vec_id % 5 END AS key FROM embeddings")
def candidate_key(spark, d):
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", fuse.candidate_key(F.when(i % 3 == 0, F.concat(F.lit("v"), i)).when(i % 3 == 1, ""), i, F.concat(F.lit("d"), i % 5)).alias("key"))


@query("SELECT doc_id, '<b>' || source || '</b>' AS cell, chr(10) || '| h | i |' || chr(10) || '|---|---|' || chr(10) || '| <b>' || source || '</b> | ' || doc_id || ' |' || chr(10) AS pipes FROM documents WHERE source IS NOT NULL")
def table_pipes(spark, d):
    t = F.concat(F.lit("<table><tr><th>h</th><th> i </th></tr><tr></tr><tr><td><b>"), "source", F.lit("</b></td><td>"), "doc_id", F.lit("</td></tr></table>"))
    return table(spark, d, "documents").where("source is not null").select("doc_id", F.concat(F.lit("<b>"), "source", F.lit("</b>")).alias("cell"), text.table_to_pipes(t).alias("pipes"))


@query("SELECT conv_id, turn, (turn % 6 + 1)::INT AS level, role || ' ' || turn AS title FROM conversations")
def markdown_headings(spark, d):
    md = F.concat(F.lit("intro # no\n"), F.repeat(F.lit("#"), (F.col("turn") % 6 + 1).cast("int")), F.lit(" "), "role", F.lit(" "), "turn", F.lit("\n#none\ntext"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.markdown_headings(md)).alias("h"))
    return rows.select("conv_id", "turn", "h.level", "h.title")


@query("SELECT doc_id, 'c' || doc_id % 3 AS file, CASE WHEN doc_id % 2 = 0 THEN 'A > B' END AS breadcrumb, CASE WHEN doc_id % 5 = 0 THEN 'mine' WHEN doc_id % 3 = 0 THEN 'h' END AS heading FROM documents")
def chunk_meta(spark, d):
    i = F.col("doc_id")
    none = F.create_map().cast("map<string,string>")
    m = text.chunk_meta(F.create_map(F.lit("file"), F.concat(F.lit("c"), i % 3)), F.when(i % 2 == 0, "A > B").otherwise(""), F.when(i % 3 == 0, "h"), F.when(i % 5 == 0, F.create_map(F.lit("heading"), F.lit("mine"))).otherwise(none))
    return table(spark, d, "documents").select("doc_id", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("file", "breadcrumb", "heading")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN ['a', 'local', 'git'][doc_id % 4 + 1] END AS kind, CASE doc_id % 4 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN 'C:/x' WHEN 2 THEN 'h/r' END AS value, CASE doc_id % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'r' END AS name FROM (SELECT doc_id FROM documents)")
def source_strings(spark, d):
    """A vault, else the list of sources, else the path; drives are local."""
    i = F.col("doc_id")
    got = paths.source_order(F.when(i % 4 == 0, F.concat(F.lit("v"), i)), F.when(i % 4 == 2, F.array(F.lit("git: h/r"))), F.when(i % 4 == 1, "C:/x"))
    one = F.get(got, 0)
    kind = F.when(one["type"] == "vault", "a").otherwise(one["type"])
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), one["value"].alias("value"), F.when(one["type"] != "vault", paths.vault_name(one["value"])).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'request' WHEN doc_id % 3 = 1 THEN 'vault' ELSE 'settings' END AS exts FROM documents")
def filter_order(spark, d):
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    got = paths.filter_precedence(F.when(i % 3 == 0, F.array(F.lit("request"))).otherwise(none), F.when(i % 3 != 2, F.array(F.lit("vault"))), F.array(F.lit("settings")))
    return table(spark, d, "documents").select("doc_id", F.array_join(got, ",").alias("exts"))


# ------------------------------------------------------------------ profiles


@query(f"WITH {PROFILES}, {VAULTS} SELECT id, name FROM profiles WHERE id IN (SELECT embed_profile_id FROM vaults UNION ALL SELECT unnest(indexed) FROM vaults)")
def used_profiles(spark, d):
    return records.used_profiles(profiles(spark, d), vaults(spark, d)).select("id", "name")


@query(f"WITH {VAULTS} SELECT id, coalesce(list_contains(indexed, 2), false) AS compatible FROM vaults")
def compatible_vaults(spark, d):
    return records.compatible(vaults(spark, d), 2).select("id", "compatible")


@query(f"WITH {VAULTS} SELECT id FROM vaults WHERE user_id = '7' AND indexed_at IS NOT NULL AND embed_profile_id IS NOT NULL")
def searchable_vaults(spark, d):
    return records.searchable(vaults(spark, d), "7").select("id")


@query(f"WITH {PROFILES} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, id) AS r FROM profiles WHERE kind = 'llm' AND enabled AND multimodal) WHERE r = 1")
def image_profiles(spark, d):
    return records.image_profiles(profiles(spark, d)).select("user_id", "id")


@query("SELECT c_custkey AS id, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 4) || '****' || right(c_name, 2) ELSE substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) END AS api_key FROM customer")
def public_profiles(spark, d):
    return records.public_profiles(profiles(spark, d)).select("id", "api_key")


@query(f"WITH {PROFILES} SELECT 'id' AS ref, (SELECT id FROM profiles WHERE enabled AND id = 4) AS id UNION ALL SELECT 'name', (SELECT id FROM profiles WHERE enabled AND name = 'Customer#000000005') UNION ALL SELECT 'default', (SELECT id FROM profiles WHERE enabled ORDER BY is_default DESC, id LIMIT 1)")
def resolve_profile(spark, d):
    p = profiles(spark, d)
    rows = [records.resolve_profile(p, r).select(F.lit(n).alias("ref"), "id") for n, r in (("id", "4"), ("name", "Customer#000000005"), ("default", None))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {PROFILES} SELECT 'vaults' AS kind, count(*) AS n FROM customer UNION ALL SELECT kind, count(*) FROM profiles GROUP BY kind")
def global_counts(spark, d):
    return records.global_counts(vaults(spark, d), profiles(spark, d))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'e' WHEN c_custkey % 3 = 1 THEN 'v' ELSE 'env' END AS profile, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS a FROM customer")
def profile_order(spark, d):
    """Which profile embeds, and a profile's parameters, bad JSON giving none."""
    i = F.col("c_custkey")
    params = text.profile_params(F.when(i % 2 == 0, '{"a":"x"}').otherwise("{bad"))
    return table(spark, d, "customer").select(i.alias("id"), records.embed_profile(F.when(i % 3 == 0, "e").otherwise(""), F.when(i % 3 == 1, "v")).alias("profile"), F.try_element_at(params, F.lit("a")).alias("a"))


@query(f"WITH {VAULTS} SELECT id, CASE WHEN id = 7 THEN 9 ELSE embed_profile_id END AS profile, CASE WHEN id = 7 THEN '9' ELSE array_to_string(list_sort(list_distinct(indexed)), ',') END AS indexed FROM vaults")
def embed_state(spark, d):
    out = maintain.touch_embed_state(vaults(spark, d), 7, 9, F.timestamp_seconds(F.lit(0)))
    return out.select("id", F.col("embed_profile_id").cast("long").alias("profile"), F.array_join(F.array_sort(F.array_distinct("embed_indexed_profiles")), ",").alias("indexed"))


# --------------------------------------------------------------- index changes


@query(f"WITH {NOTES} SELECT id, file_path, CASE WHEN id % 5 = 0 THEN 1 ELSE size_bytes END AS size_bytes FROM notes")
def upsert_notes(spark, d):
    n = notes(spark, d)
    return maintain.upsert_notes(n, n.where("id % 5 = 0").withColumn("size_bytes", F.lit(1).cast("long"))).select("id", "file_path", "size_bytes")


@query(f"WITH {CHUNKS} SELECT note_id, idx FROM chunks WHERE note_id % 4 <> 0 UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 8 = 0")
def replace_chunks(spark, d):
    """Notes divisible by 4 are cut anew; half of them give no chunk."""
    c = chunks(spark, d).select("note_id", F.col("idx").cast("long").alias("idx"))
    ids = notes(spark, d).selectExpr("id as note_id")
    return maintain.replace_chunks(c, ids.where("note_id % 4 = 0"), ids.where("note_id % 8 = 0").select("note_id", F.lit(9).cast("long").alias("idx")))


@query(f"WITH {NOTES}, {CHUNKS} SELECT (SELECT count(*) FROM notes WHERE id % 6 <> 0) AS notes, (SELECT count(*) FROM chunks WHERE note_id % 6 <> 0) AS chunks, (SELECT count(*) FROM chunks WHERE note_id % 6 <> 0) AS vectors")
def drop_files(spark, d):
    n, c = notes(spark, d), chunks(spark, d)
    left = maintain.drop_files(n, c, c, n.where("id % 6 = 0").select("vault_id", "file_path"))
    one = [x.agg(F.count("*").alias(k)) for x, k in zip(left, ("notes", "chunks", "vectors"))]  # a row each
    return one[0].crossJoin(one[1]).crossJoin(one[2])


@query(f"WITH {NOTES} SELECT id, CASE WHEN id % 9 = 0 THEN 'moved/' || id ELSE file_path END AS file_path, mtime_ns FROM notes")
def move_files(spark, d):
    n = notes(spark, d)
    moved = n.where("id % 9 = 0").selectExpr("vault_id", "file_path as old_path", "concat('moved/', id) as new_path")
    return maintain.move_files(n, moved).select("id", "file_path", "mtime_ns")


@query(f"WITH {NOTES} SELECT id, CASE WHEN id % 2 = 0 THEN size_bytes + 5 ELSE size_bytes END AS size_bytes, CASE WHEN id % 2 = 0 THEN 7 ELSE mtime_ns END AS mtime_ns FROM notes")
def refresh_signatures(spark, d):
    n = notes(spark, d)
    seen = n.selectExpr("file_path as rel_path", "size_bytes + 5 as size_bytes", "cast(7 as long) as mtime_ns", "if(id % 2 = 0, content_hash, 'other') as content_hash")
    return maintain.refresh_signatures(n, seen).select("id", "size_bytes", "mtime_ns")


@query("""SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN 'a ' || '<!-- IMAGE_START -->' || chr(10) || 'cat' || chr(10) || '<!-- IMAGE_END -->' || ' b ' || '<!-- IMAGE_START -->' || chr(10) || 'dog' || chr(10) || '<!-- IMAGE_END -->' || ' ![](c)' ELSE 'a ![](x) b ![](y) ![](c)' END AS text,
CASE WHEN doc_id % 2 = 0 THEN '2,11' ELSE '' END AS offsets FROM documents""")
def splice_images(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as doc", "0 as chunk_index", "'a ![](x) b ![](y) ![](c)' as text")
    refs = docs.where("doc % 2 = 0").selectExpr("doc", "inline_outer(array(named_struct('raw', '![](x)', 'uid', 'u', 'description', 'cat', 'ord', 0), named_struct('raw', '![](y)', 'uid', 'v', 'description', 'dog', 'ord', 1), named_struct('raw', '![](c)', 'uid', 'w', 'description', '', 'ord', 2)))")
    out = maintain.splice_images(docs, refs)
    return out.select("doc", "text", F.array_join(F.transform(F.coalesce("images", F.array().cast(out.schema["images"].dataType)), lambda i: i["offset"].cast("string")), ",").alias("offsets"))


def _cache(spark, d):
    return table(spark, d, "documents").selectExpr("source as user_id", "concat('k', doc_id) as content_key", "concat('img', doc_id) as uid", "concat('old', doc_id) as source_ref", "if(doc_id % 4 = 0, '', 'cat') as content")


@query("""WITH c AS (SELECT 'k' || doc_id AS content_key, 'img' || doc_id AS uid, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'old' || doc_id END AS source_ref, CASE WHEN doc_id % 3 = 0 THEN 'dog' WHEN doc_id % 4 = 0 THEN '' ELSE 'cat' END AS content FROM documents)
SELECT * FROM c""")
def cache_images(spark, d):
    new = _cache(spark, d).where("substring(content_key, 2) % 3 = 0").withColumns({"content": F.lit("dog"), "source_ref": F.expr("if(substring(content_key, 2) % 6 = 0, 'new', '')")})
    return maintain.cache_images(_cache(spark, d), new).drop("user_id")


@query("SELECT 'k' || doc_id AS content_key FROM documents WHERE doc_id % 4 = 0")
def to_describe(spark, d):
    c = _cache(spark, d)
    return maintain.to_describe(c.select("user_id", "content_key"), c).select("content_key")


# -------------------------------------------------------------------- runs


@query(f"""WITH r AS (SELECT event_id, {RUN_STATUS} AS status, event_id % 2 = 0 AS dry, event_id % 3 = 0 AS cancel, CASE event_id % 4 WHEN 0 THEN 'over_ratio' WHEN 1 THEN 'scan_incomplete' END AS why FROM events)
SELECT event_id AS run_id, CASE WHEN dry AND o THEN event_id END AS planned, CASE WHEN NOT dry AND o THEN event_id END AS resulted, coalesce(why = 'over_ratio', false) AS prune_blocked, cancel AND NOT o AS cancelling FROM (SELECT *, status IN ('success', 'failed', 'cancelled') AS o FROM r)""")
def run_detail(spark, d):
    runs = _runs(spark, d).selectExpr("run_id", "status", "run_id % 2 = 0 as dry_run", "run_id % 3 = 0 as cancel_requested", "run_id as adds", "0 as updates", "0 as moves", "0 as deletes", "0 as unchanged", "0 as failed_cnt", "case run_id % 4 when 0 then 'over_ratio' when 1 then 'scan_incomplete' end as blocked_reason")
    return records.run_detail(runs).select("run_id", F.col("plan.adds").alias("planned"), F.col("result.adds").alias("resulted"), "prune_blocked", "cancelling")


@query("SELECT user_id AS run, arg_max(event_type, event_id) AS stage, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS processed FROM events GROUP BY user_id")
def latest_run_state(spark, d):
    log = table(spark, d, "events").selectExpr("user_id as run", "event_id as at", "event_type as stage", "if(event_id % 2 = 0, event_id, null) as processed")
    return records.latest_state(log, "run", "at", ["stage", "processed"])


@query(f"SELECT event_id AS run_id, {RUN_STATUS} IN ('running', 'queued') AS active FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND {RUN_STATUS} = 'running'")
def task_list(spark, d):
    return records.run_table(_runs(spark, d), only_status="running", since=F.lit("2024-01-05").cast("timestamp_ntz")).select("run_id", "active")


@query("SELECT event_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_runs(spark, d):
    """The newest twenty runs: the list is what the operator is about."""
    return records.newest(_runs(spark, d), ["started_at", "run_id"], 20).select("run_id")


@query("SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 50")
def newest_conversations(spark, d):
    """The newest fifty conversations: the list is what the operator is about."""
    return records.newest(table(spark, d, "conversations").select("conv_id").distinct(), ["conv_id"], 50)


@query(f"""SELECT event_id AS run_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 > 0 THEN 'partial' ELSE 'success' END AS ended,
{RUN_STATUS} = 'success' AND event_id % 2 <> 0 AS writes_back,
CASE WHEN event_id % 11 = 0 THEN 'source_unavailable' WHEN event_id % 2 = 0 THEN 'prune_disabled' WHEN event_id % 3 = 0 THEN 'scan_incomplete' WHEN event_id % 10 > 0 AND event_id % 4 / (event_id % 10)::DOUBLE > 0.5 THEN 'over_ratio' END AS blocked FROM events""")
def run_ends(spark, d):
    """How a run ends, whether it changes its vault, and why deletions are held back, the first reason of several."""
    i = F.col("run_id")
    guard = reconcile.blocked(i % 10, i % 4, F.lit(False), i % 2 != 0, i % 3 != 0, available=i % 11 != 0)
    return _runs(spark, d).select("run_id", reconcile.run_status(i % 7 == 0, i % 5 == 0, i % 3).alias("ended"), records.writes_back(F.col("status"), i % 2 == 0).alias("writes_back"), guard.alias("blocked"))


@query("SELECT conv_id, turn, 'system,user,user' AS roles, 'S' || chr(10) || chr(10) || role AS first FROM conversations")
def prompt_messages(spark, d):
    history = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    p = fuse.prompt(F.lit("S"), F.col("role"), history, F.lit("q"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(p, lambda m: m["role"]), ",").alias("roles"), p[0]["content"].alias("first"))


@query(f"""WITH {PLAN} SELECT CASE action WHEN 'move' THEN 1 WHEN 'delete' THEN 3 ELSE 2 END AS step, action, old_path, new_path,
CASE WHEN action = 'delete' THEN 'blocked' WHEN action IN ('add', 'update') AND length(new_path) % 4 = 0 THEN 'failed' ELSE 'done' END AS outcome FROM plan WHERE action <> 'unchanged'""")
def apply_plan(spark, d):
    """Outcome of each file when a plan is carried out, failures recorded and deletes held back."""
    planned = _plan(spark, d)
    failed = planned.where("action in ('add', 'update') and length(new_path) % 4 = 0").selectExpr("new_path as rel_path")
    return reconcile.apply_plan(planned, failed, F.lit(True))


@query("""SELECT CASE WHEN doc_id % 10 = 2 THEN 'moved/' || doc_id ELSE source || '/' || doc_id || '.txt' END AS rel_path FROM documents WHERE doc_id % 10 <> 1
UNION ALL SELECT 'new/' || doc_id FROM documents WHERE doc_id % 10 = 5""")
def applied_notes(spark, d):
    """Once a whole plan is carried out, what is indexed is what the scan saw."""
    planned = _plan(spark, d)
    done = reconcile.apply_plan(planned, planned.limit(0).selectExpr("new_path as rel_path"), F.lit(False))
    return reconcile.applied_notes(notes(spark, d).withColumnRenamed("file_path", "rel_path"), done, _seen(spark, d)).select("rel_path")


#: What each document refers to, and what is stored beside it.
REFS = """refs AS (SELECT doc_id, source AS vault, lang || '/' || doc_id || '.md' AS note, CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'wiki' ELSE 'html' END AS kind,
  CASE doc_id % 7 WHEN 0 THEN 'img/' || doc_id || '.png' WHEN 1 THEN '' || doc_id WHEN 2 THEN '../' || doc_id || '.png' WHEN 3 THEN '../../' || doc_id || '.png' WHEN 4 THEN doc_id || '%20a.png' WHEN 5 THEN './' || doc_id || '.png' ELSE '../' || lang || '/img/' || doc_id END AS target, lang FROM documents),
files AS (SELECT vault, unnest(CASE doc_id % 5 WHEN 0 THEN [lang || '/img/' || doc_id || '.png'] WHEN 1 THEN ['attachments/' || doc_id || '.jpg', lang || '/' || doc_id || ' a.png'] WHEN 2 THEN [doc_id || '.png', 'media/' || doc_id || ' a.png']
  WHEN 3 THEN ['assets/' || doc_id || '.webp', 'media/' || doc_id || '.gif', lang || '/' || doc_id || '.png'] ELSE [lang || '/' || doc_id || '.tiff', lang || '/' || doc_id || '%20a.png'] END) AS path FROM refs)"""


@query(f"""WITH {REFS}, based AS (SELECT *, unnest(CASE WHEN kind = 'wiki' THEN [lang, '', 'attachments', 'assets', 'images', 'img', 'media', 'files'] ELSE [lang] END) AS base, unnest(range(8)) AS b FROM refs),
named AS (SELECT *, unnest([target, replace(target, '%20', ' ')]) AS name, unnest([0, 1]) AS n FROM based WHERE base IS NOT NULL),
tried AS (SELECT *, name || unnest(CASE WHEN name LIKE '%.png' THEN [''] ELSE ['', '.png', '.jpg', '.jpeg', '.gif', '.webp', '.bmp', '.tif', '.tiff'] END) AS file, unnest(range(9)) AS e FROM named),
placed AS (SELECT doc_id, vault, 1000 * b + 100 * n + e AS place, CASE WHEN file LIKE '../../%' OR (file LIKE '../%' AND base = '') THEN NULL WHEN file LIKE '../%' THEN substr(file, 4) ELSE ltrim(base || '/' || replace(file, './', ''), '/') END AS path FROM tried WHERE file IS NOT NULL),
found AS (SELECT doc_id, arg_min(path, place) AS resolved FROM placed JOIN (SELECT DISTINCT * FROM files) USING (vault, path) GROUP BY doc_id)
SELECT doc_id, note, kind, target, resolved FROM refs LEFT JOIN found USING (doc_id)""")
def image_paths(spark, d):
    """Files that references planted beside each document mean."""
    docs = table(spark, d, "documents")
    s = F.col("doc_id").cast("string")
    pick = lambda n, *of: functools.reduce(lambda w, i: w.when(F.col("doc_id") % n == i, of[i]), range(1, n), F.when(F.col("doc_id") % n == 0, of[0]))
    at = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    lang = F.col("lang")
    target = pick(7, at("img/", s, ".png"), s, at("../", s, ".png"), at("../../", s, ".png"), at(s, "%20a.png"), at("./", s, ".png"), at("../", lang, "/img/", s))
    refs = docs.select("doc_id", F.col("source").alias("vault"), at(lang, "/", s, ".md").alias("note"), pick(3, F.lit("md"), F.lit("wiki"), F.lit("html")).alias("kind"), target.alias("target"))
    stored = pick(
        5,
        F.array(at(lang, "/img/", s, ".png")),
        F.array(at("attachments/", s, ".jpg"), at(lang, "/", s, " a.png")),
        F.array(at(s, ".png"), at("media/", s, " a.png")),
        F.array(at("assets/", s, ".webp"), at("media/", s, ".gif"), at(lang, "/", s, ".png")),
        F.array(at(lang, "/", s, ".tiff"), at(lang, "/", s, "%20a.png")),
    )
    files = docs.select(F.col("source").alias("vault"), F.explode(stored).alias("path"))
    return images.resolve(refs, files).select("doc_id", "note", "kind", "target", "resolved")


#: Events as steps of runs, a user's as those of one run, and which of them count.
STEPS = """e AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancel' END AS step FROM events),
b AS (SELECT *, count(*) FILTER (step = 'create') OVER p > 0 AS made FROM e WINDOW p AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, count(*) FILTER (made AND step IN ('success', 'failed')) OVER p AS ends, count(*) FILTER (made AND step = 'start') OVER p AS starts FROM b
  WINDOW p AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
steps AS (SELECT run_id, event_id, ts, step, CASE step WHEN 'create' THEN NOT made WHEN 'start' THEN made AND ends = 0 AND starts = 0 WHEN 'cancel' THEN made AND ends = 0 ELSE made END AS accepted FROM c)"""


def _steps(spark, d):
    names = F.create_map(*(F.lit(x) for pair in (("signup", "create"), ("click", "start"), ("purchase", "success"), ("error", "failed"), ("view", "cancel")) for x in pair))
    log = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", names[F.col("event_type")].alias("step"))
    return records.guarded_steps(log, "run_id", ["ts", "event_id"], "step")


@query(f"WITH {STEPS} SELECT run_id, event_id, step, accepted FROM steps")
def run_steps(spark, d):
    """Which steps of each run's log were allowed in the state that it was in."""
    return _steps(spark, d).select("run_id", "event_id", "step", "accepted")


@query(f"""WITH {STEPS}, s AS (SELECT run_id, arg_max(step, (ts, event_id)) FILTER (step IN ('success', 'failed')) AS ended, bool_or(step = 'start') AS begun, min(ts) FILTER (step = 'create') AS started_at,
  arg_max(ts, (ts, event_id)) FILTER (step IN ('success', 'failed')) AS finished_at, bool_or(step = 'cancel') AS cancel_requested FROM steps WHERE accepted GROUP BY run_id)
SELECT run_id, coalesce(ended, CASE WHEN begun THEN 'running' ELSE 'queued' END) AS status, started_at, finished_at, coalesce((epoch_us(finished_at) - epoch_us(started_at)) // 1000, 0) AS elapsed_ms, cancel_requested FROM s""")
def run_states(spark, d):
    """State of each run after its allowed steps."""
    return records.states_of_steps(_steps(spark, d), "run_id", ["ts", "event_id"], "step", "ts")
