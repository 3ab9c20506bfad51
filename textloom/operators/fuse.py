"""Rank fusion, rerank and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.bm25 import top
from textloom.providers import Reranker

RRF = 60
#: Candidates asked of each recall: a multiple of k, within bounds.
POOL = (4, 20, 100)


def pool_size(k: int, times: int = POOL[0], low: int = POOL[1], high: int = POOL[2]) -> int:
    """Candidates of a recall; settled before the plan is built, since a limit must be known."""
    if low > high:
        raise ValueError("the least pool is larger than the most")
    return min(max(k * times, low), high)


def pool_column(k: Column, times: int = POOL[0], low: int = POOL[1], high: int = POOL[2]) -> Column:
    return F.least(F.greatest(k * times, F.lit(low)), F.lit(high))


def vector_pool(k: int, lexical: bool, reranker: bool) -> int:
    """Candidates of the vector recall: as many as asked for where nothing comes after it."""
    return pool_size(k) if lexical or reranker else k


def candidate_key(vector_id: Column, note_id: Column, document: Column) -> Column:
    """What tells a candidate: its vector, else its note and text."""
    return F.coalesce(F.nullif(vector_id, F.lit("")), F.concat_ws(":", note_id.cast("string"), document))


#: Decimals of the scores that a tool shows, and the least and most hits it may be asked for.
DECIMALS = {"score": 4, "bm25_score": 6, "fusion_score": 6, "rerank_score": 4}
TOOL_K = (1, 50)


def tool_scores(hits: DataFrame) -> DataFrame:
    """Hits with their scores rounded as a tool shows them; nulls stay."""
    return hits.withColumns({c: F.round(c, n) for c, n in DECIMALS.items() if c in hits.columns})


def tool_k(k: Column) -> Column:
    return F.least(F.greatest(k, F.lit(TOOL_K[0])), F.lit(TOOL_K[1]))


def hybrid(vector: DataFrame, lexical: DataFrame, query_id: str, key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two recalls (query, key, rank, score).

    Hits of both keep the vector's score and gain bm25_score; those of the
    lexical recall alone have score 0.  Equal sums keep the order of the vector
    recall, then that of the lexical one.
    """
    one = lambda df, list_: df.select(query_id, key, F.lit(list_).alias("list"), "rank", "score")
    both = one(vector, 0).unionByName(one(lexical, 1))
    of = lambda list_, c: F.max(F.when(F.col("list") == list_, F.col(c)))
    fused = both.groupBy(query_id, key).agg(
        F.sum(1.0 / (F.lit(RRF) + F.col("rank"))).alias("fusion"),
        of(0, "score").alias("v"),
        of(1, "score").alias("bm25_score"),
        of(0, "rank").alias("vector_rank"),
        of(1, "rank").alias("bm25_rank"),
    )
    rows = fused.select(query_id, key, F.round("fusion", 6).alias("fusion_score"), F.coalesce("v", F.lit(0.0)).alias("score"), "bm25_score", F.col("v").isNotNull().alias("vector_recalled"), "vector_rank", "bm25_rank")
    return top(rows, [query_id], [F.desc("fusion_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), F.col(key)], k).drop("vector_rank", "bm25_rank")


def across_scopes(hits: DataFrame, query_id: str, scope_order: str, key: str, k: int) -> DataFrame:
    """One ranking from those of several scopes (query, scope_order, key, rank): the place in its scope decides,
    then the scopes' order.  All scopes in one job."""
    scored = hits.withColumn("fusion_score", F.round(1.0 / (F.lit(RRF) + F.col("rank")), 6)).withColumnRenamed("rank", "scope_rank")
    return top(scored, [query_id], [F.col("scope_rank"), F.col(scope_order), F.col(key)], k)


def rerank_text(title: Column, content: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def valid_scores(found: list[tuple[int, float]], n: int) -> list[tuple[int, float]] | None:
    """A reranker's answer, best first; None if it is empty, repeats or leaves the candidates, or scores outside 0 to 1."""
    seen = {i for i, _ in found}
    sound = bool(found) and len(seen) == len(found) and all(isinstance(i, int) and 0 <= i < n and isinstance(s, (int, float)) and 0.0 <= s <= 1.0 for i, s in found)
    return sorted(found, key=lambda x: -x[1]) if sound else None


def rerank(hits: DataFrame, query_id: str, key: str, query_text: str, document: str, reranker: Reranker, k: int, most: int = 100) -> DataFrame:
    """query, key, rank and rerank_score of each query's hits (query, key, rank, text, document).

    The ``most`` first hits are sent; what the reranker leaves out is dropped.
    If it fails or answers badly the order stays and rerank_score is null.  A
    group is one query's pool, bounded by ``most``.
    """

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        try:
            found = valid_scores(reranker.rerank(g[query_text].iloc[0], g[document].tolist(), min(k, len(g))), len(g))
        except Exception:
            found = None
        chosen = [(i, None) for i in range(min(k, len(g)))] if found is None else found[:k]
        keys = g[key].tolist()
        return pd.DataFrame({query_id: g[query_id].iloc[0], key: [keys[i] for i, _ in chosen], "rank": range(1, len(chosen) + 1), "rerank_score": pd.array([s for _, s in chosen], dtype="Float64")})

    types = dict(hits.dtypes)
    sent = hits.where(F.col("rank") <= most).select(query_id, key, "rank", query_text, document)
    return sent.groupBy(query_id).applyInPandas(work, f"{query_id} {types[query_id]}, {key} {types[key]}, rank int, rerank_score double")


def overlap_rerank(hits: DataFrame, query_id: str, key: str, query_terms: Column, document_terms: Column, k: int) -> DataFrame:
    """A reranker in the JVM: the share of a query's terms that the document has."""
    score = F.round(F.size(F.array_intersect(query_terms, document_terms)) / F.size(F.array_distinct(query_terms)), 6)
    scored = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "pool_rank")
    return top(scored, [query_id], [F.desc("rerank_score"), F.col("pool_rank")], k)


def context(hits: DataFrame, query_id: str, path: str, content: str, vault: str | None = None) -> DataFrame:
    """One text for each query: its hits, numbered by rank, with where they are from."""
    where = F.concat_ws(" · ", *([F.col(vault)] if vault else []), F.col(path))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 来源："), where, F.lit("\n"), F.col(content))
    listed = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b")))).alias("x"))
    return listed.select(query_id, F.array_join(F.transform("x", lambda s: s["b"]), "\n\n").alias("context"))


HISTORY = 10


def prompt(system: Column, context_text: Column, history: Column, question: Column) -> Column:
    """Messages for a generator: system with context, history, question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(F.array(message("system", F.concat(system, F.lit("\n\n"), context_text))), history, F.array(message("user", question)))


def last_messages(messages: DataFrame, conversation: str, order: list[str], n: int = HISTORY) -> DataFrame:
    """The ``n`` newest messages of each conversation, oldest first, with their place from 1."""
    newest = Window.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    kept = messages.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(conversation).orderBy(*order))).drop("__back")


def drain(hits: DataFrame, generator, messages: list[dict]) -> Iterator[dict]:
    """Events of a chat: the sources, then tokens, then done or an error."""
    yield {"event": "sources", "data": [r.asDict(recursive=True) for r in hits.collect()]}
    try:
        for token in generator.stream(messages):
            yield {"event": "token", "data": token}
    except Exception as e:
        yield {"event": "error", "data": str(e)}
        return
    yield {"event": "done", "data": None}
