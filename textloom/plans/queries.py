"""Queries over the driver's tables, one for each operator that rows can show.

``documents`` stand for files: ``source`` is the vault, ``source/doc_id.txt``
the path.  ``embeddings`` are taken as those of the documents with the same id,
``events`` as runs of a vault (the user), ``customer`` as model profiles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import paths, text
from textloom.operators import bm25, chunk, fuse, knn, reconcile, records
from textloom.operators.lexical_index import LexicalIndex
from textloom.storage import fingerprint, shared_root
from textloom.streaming import jobs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = "concat(source, '/', doc_id, '.txt')"


def _columns() -> dict:
    return {"path": F.col("source"), "content": F.col("text")}


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str) -> LexicalIndex:
    """The stored index of the documents, built when it is first asked for."""
    index = LexicalIndex(spark, f"{shared_root(spark)}/lexical-{fingerprint(spark, f'{d}/documents.parquet')}", "doc_id", _columns())
    index.backfill(table(spark, d, "documents"))
    return index


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return _index(spark, d).search(_queries(spark, d), "query_id", "query", k)


# ---------------------------------------------------------------- retrieval


def term_stats(spark, d):
    tokened = bm25.tokens(table(spark, d, "documents"), "doc_id", {"content": F.col("text")})
    return bm25.term_stats(tokened, "doc_id", ["content"])


def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


def bm25_topk(spark, d):
    return _lexical(spark, d, 10)


def index_changes(spark, d):
    """Best five after a tenth of the documents went, a tenth was written anew, a tenth moved, and a tenth came later."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    index = LexicalIndex(spark, f"{shared_root(spark)}/changes-{uuid.uuid4().hex}", "doc_id", _columns())
    index.backfill(docs.where("doc_id % 10 <> 4"))
    index.delete(docs.where("doc_id % 10 = 1"))
    index.replace(docs.where("doc_id % 10 = 2").withColumn("text", F.concat(F.lit("written anew "), F.reverse("text"))))
    index.replace(docs.where("doc_id % 10 = 3").withColumn("source", F.concat(F.lit("moved/"), F.col("source"))))
    index.insert(docs.where("doc_id % 10 = 4"))
    index.merge()
    index.delete(docs.where("doc_id % 10 = 5"))
    return index.search(_queries(spark, d), "query_id", "query", 5)


def _short_queries(spark, d):
    """Three terms of each benchmark item."""
    terms = text.query_terms(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(terms, 1, 3), " ").alias("query"))


def bm25_short(spark, d):
    """Ten best documents of short queries, from the ranges whose bounds reach their thresholds."""
    return _index(spark, d).search(_short_queries(spark, d), "query_id", "query", 10)


def index_reads(spark, d):
    """Blocks of each short query's terms, and how many of them its ten best documents take."""
    return _index(spark, d).reads(_short_queries(spark, d), "query_id", "query", 10)


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def knn_exact(spark, d):
    return knn.exact(table(spark, d, "embeddings"), _vector_queries(spark, d), 10)


def knn_threshold(spark, d):
    return knn.exact(table(spark, d, "embeddings"), _vector_queries(spark, d), 20, threshold=0.3)


def knn_lsh(spark, d):
    return knn.approximate(table(spark, d, "embeddings"), _vector_queries(spark, d), 10, 64)


def _vector_recall(spark, d, k):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, d, "embeddings").join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return knn.exact(vectors, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), k, key="doc_id")


def hybrid_rrf(spark, d):
    """Best five documents of each benchmark item by both recalls."""
    pool = fuse.pool_size(5)
    return fuse.hybrid(_vector_recall(spark, d, pool), _lexical(spark, d, pool), "query_id", "doc_id", 5)


def cross_scope_rrf(spark, d):
    """Languages as scopes: five of each, fused."""
    ranked = _index(spark, d).search_scopes(_queries(spark, d), "query_id", "query", table(spark, d, "documents"), "lang", 5)
    return fuse.across_scopes(ranked, "query_id", "lang", "doc_id", 5).select("query_id", "rank", "lang", "doc_id", "fusion_score")


def rerank_local(spark, d):
    """Best five of twenty by the share of the query's terms they hold."""
    pool = _lexical(spark, d, 20).join(_queries(spark, d), "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    out = fuse.overlap_rerank(pool, "query_id", "doc_id", text.query_terms(F.col("query")), text.words(F.col("text")), 5)
    return out.select("query_id", "rank", "doc_id", "rerank_score")


class _Down:
    def rerank(self, query, documents, top_n):
        raise TimeoutError("no answer")


def rerank_fallback(spark, d):
    """A reranker that fails leaves the order as it was."""
    pool = _lexical(spark, d, 20).join(_queries(spark, d), "query_id").withColumn("document", F.col("doc_id").cast("string"))
    return fuse.rerank(pool, "query_id", "doc_id", "query", "document", _Down(), 5)


def candidate_pool(spark, d):
    """Candidates of a recall for as many results as a conversation's turn has words."""
    k = F.size(text.words(F.col("text"))).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", k.alias("k"), fuse.pool_column(k).alias("pool"))


def context_block(spark, d):
    hits = _lexical(spark, d, 3).join(table(spark, d, "documents").selectExpr("doc_id", f"{PATH} as path", "text as content", "lang"), "doc_id")
    return fuse.context(hits, "query_id", "path", "content", "lang")


# ------------------------------------------------------------------- chunks


def hard_split(spark, d):
    return chunk.hard_split(table(spark, d, "documents"), "text", ["doc_id"])


def recursive_chunk(spark, d):
    return chunk.chunks(table(spark, d, "documents"), "text", "text", ["doc_id"])


def html_chunk(spark, d):
    return chunk.chunks(table(spark, d, "pages"), "html", "html", ["page_id"])


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(text.html_headings(F.col("html"))).alias("place", "h")).select("page_id", "place", "h.level", "h.title")


def breadcrumbs(spark, d):
    """Turns of a conversation as headings whose level follows from the turn."""
    heads = F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") * 7 % 5 + 1).cast("int").alias("level"), F.concat("role", F.col("turn").cast("string")).alias("title"))))
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(heads.alias("h"))
    crumbs = text.breadcrumbs(F.transform("h", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"))))
    return grouped.select("conv_id", F.posexplode(crumbs).alias("place", "crumb"))


def image_refs(spark, d):
    """References planted around each turn."""
    t = F.concat(F.lit("![a b](<x y.png> \"t\") "), F.col("text"), F.lit(" ![[b.png#top|300]] ![[c.png|alt]] <img src='d.png'>"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.image_refs(t)).alias("r"))
    return rows.select("conv_id", "turn", "r.*")


def image_shell(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[A > B]\n![p](q:"), F.col("turn").cast("string"), F.lit(") "))).otherwise(F.concat(F.lit("[A]\n"), F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_image_shell(t).alias("shell"))


# ------------------------------------------------------------------ scalars


def content_hash16(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.vector_id(F.lit(1), F.col("doc_id"), F.lit(0)).alias("vector_id"))


def image_uid(spark, d):
    return table(spark, d, "pages").select("page_id", text.image_uid(F.lit("u1"), F.sha2("url", 256)).alias("uid"))


def mask_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.mask_key(F.expr("substring(c_name, 1, cast(c_custkey % 19 as int))")).alias("masked"))


def epoch_ms(spark, d):
    return table(spark, d, "events").select("event_id", text.epoch_ms(F.col("ts")).alias("ms"), F.expr("(event_id * 1000003) div 1000000").alias("mtime_ms"))


def glob_filter(spark, d):
    files = table(spark, d, "documents").selectExpr(f"{PATH} as rel_path", "n_chars as size_bytes")
    keep = paths.wanted(F.col("rel_path"), F.col("size_bytes"), include=["src1*/*", "*/?[0-4]*.txt"], exclude=["src3/**", "*9.txt"], exts=["txt", ".MD"], max_size=20_000)
    return files.where(keep)


def chunk_formats(spark, d):
    named = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".md", ".HTML", ".txt", ".docx", ".xlsx", ""))), (F.col("doc_id") % 6 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", paths.chunk_format(named).alias("format"))


# ----------------------------------------------------------- reconciliation


def _known(spark, d):
    return table(spark, d, "documents").selectExpr(f"{PATH} as rel_path", "n_chars as size_bytes", "doc_id * 1000 as mtime_ns", "substring(sha2(text, 256), 1, 16) as content_hash", "doc_id", "text")


def _seen(spark, d):
    """Of ten files one is gone, one moved, one touched, one changed, and one has a new file beside it."""
    kept = _known(spark, d).where("doc_id % 10 <> 1").selectExpr(
        "if(doc_id % 10 = 2, concat('moved/', doc_id), rel_path) as rel_path",
        "if(doc_id % 10 = 4, size_bytes + 1, size_bytes) as size_bytes",
        "if(doc_id % 10 in (3, 4), mtime_ns + 1, mtime_ns) as mtime_ns",
        "if(doc_id % 10 = 4, substring(sha2(concat(text, 'x'), 256), 1, 16), content_hash) as content_hash",
    )
    new = _known(spark, d).where("doc_id % 10 = 5").selectExpr("concat('new/', doc_id) as rel_path", "size_bytes", "mtime_ns", "substring(sha2(concat(text, 'new'), 256), 1, 16) as content_hash")
    return kept.unionByName(new)


def _plan(spark, d):
    return reconcile.plan(_seen(spark, d), _known(spark, d).drop("doc_id", "text"))


def reconcile_plan(spark, d):
    return _plan(spark, d)


def need_hash(spark, d):
    return reconcile.need_hash(_seen(spark, d), _known(spark, d).drop("doc_id", "text")).select("rel_path")


def move_pairs(spark, d):
    return reconcile.moves(reconcile.classify(_seen(spark, d), _known(spark, d)))


def prune_guard(spark, d):
    return reconcile.summary(_plan(spark, d), ratio=0.05)


def plan_samples(spark, d):
    return reconcile.samples(_plan(spark, d)).select("action", F.array_join("paths", ",").alias("paths"))


def _doctor(spark, d):
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").selectExpr("concat('v', vec_id) as vector_id")
    chunks = docs.where("doc_id % 3 <> 0").selectExpr("concat('v', doc_id) as vector_id", "doc_id as note_id")
    return vectors, chunks, docs.selectExpr("doc_id as id")


def doctor_ghost(spark, d):
    v, c, _ = _doctor(spark, d)
    return reconcile.ghosts(v, c)


def doctor_missing(spark, d):
    v, c, _ = _doctor(spark, d)
    return reconcile.missing(c, v)


def doctor_orphan(spark, d):
    _, c, n = _doctor(spark, d)
    return reconcile.orphans(n, c)


def doctor_report(spark, d):
    v, c, n = _doctor(spark, d)
    return reconcile.doctor(v, c, n)


def doctor_repair(spark, d):
    v, c, _ = _doctor(spark, d)
    return reconcile.repair(v, c)


# ----------------------------------------------------------------- records


def _states(spark, d):
    docs = table(spark, d, "documents").selectExpr(f"{PATH} as rel_path", "n_chars as size_bytes", "doc_id")
    notes = docs.where("doc_id % 2 = 0").selectExpr("rel_path as file_path")
    return records.file_states(docs, notes, docs.where("doc_id % 7 = 0"), F.lit("src11/11.txt"))


def file_status_page(spark, d):
    """The second page of fifty files; the page is what the operator is about."""
    return records.file_page(_states(spark, d), 2, 50, search="SRC1").select("rel_path", "size_bytes", "status")


def file_status_counts(spark, d):
    return records.status_counts(_states(spark, d))


def browse_dirs(spark, d):
    return records.browse(table(spark, d, "documents").selectExpr("if(doc_id % 2 = 0, concat(source, '/', lang, '/', doc_id), concat(source, '/', doc_id)) as rel_path"))


def scope_counts(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "vault_id")
    vaults = docs.select("vault_id").distinct().unionByName(spark.createDataFrame([("empty",)], "vault_id string"))
    return records.scope_counts(vaults, docs, docs.where("n_chars > 1000"))


def conversation_list(spark, d):
    return records.conversation_list(table(spark, d, "conversations")).select("conv_id", "message_count", "title")


def conversation_history10(spark, d):
    return fuse.last_messages(table(spark, d, "conversations"), "conv_id", ["turn"], 10)


def _runs(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("success", "failed", "running", "queued", "cancelled"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("vault_id"), status.alias("status"), F.col("ts").alias("started_at"))


def run_retention(spark, d):
    return records.retained(_runs(spark, d), "vault_id", "run_id", "status", "started_at", 20)


def stale_recovery(spark, d):
    return records.recovered(_runs(spark, d)).groupBy("vault_id", "status").agg(F.count("*").alias("n"))


def latest_active(spark, d):
    return records.latest_active(_runs(spark, d), "vault_id", "run_id", "status", "started_at")


def run_kpis(spark, d):
    return records.kpis(_runs(spark, d), "status", "started_at", F.to_date(F.lit("2024-01-15")))


def _profiles(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_nationkey as string) as user_id", "c_mktsegment as kind", "c_name as name", "c_custkey % 7 = 0 as is_default", "c_custkey % 3 <> 0 as enabled")


def default_profile(spark, d):
    return records.default_profiles(_profiles(spark, d)).select("user_id", "kind", "id", "name")


def exclusive_default(spark, d):
    return records.set_default(_profiles(spark, d), 42).select("id", "is_default")


# ------------------------------------------------------------------- events


def debounce_sessions(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.debounce(events, "user_id", quiet="30 minutes", late=None)
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("due_at").cast("timestamp_ntz").alias("due_at"), "changes")


def hourly_counts(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(events, "event_type", late=None).select(F.col("from_at").cast("timestamp_ntz").alias("from_at"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        term_stats, query_terms, bm25_topk, bm25_short, index_changes, index_reads, knn_exact, knn_threshold, knn_lsh, hybrid_rrf, cross_scope_rrf, rerank_local, rerank_fallback,
        candidate_pool, context_block, hard_split, recursive_chunk, html_chunk, html_text, html_headings, breadcrumbs, image_refs, image_shell,
        content_hash16, image_uid, mask_key, epoch_ms, glob_filter, chunk_formats, reconcile_plan, need_hash, move_pairs, prune_guard,
        plan_samples, doctor_ghost, doctor_missing, doctor_orphan, doctor_report, doctor_repair, file_status_page, file_status_counts,
        browse_dirs, scope_counts, conversation_list, conversation_history10, run_retention, stale_recovery, latest_active, run_kpis,
        default_profile, exclusive_default, debounce_sessions, hourly_counts,
    )
}
