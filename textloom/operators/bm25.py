"""BM25 over weighted columns, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import query_terms, words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weights of title, path and content.
WEIGHTS = {"title": 4.0, "path": 2.0, "content": 1.0}


def tokens(docs: DataFrame, key: str, columns: dict[str, Column], cut: Callable[[Column], Column] = words) -> DataFrame:
    """key, length (terms in all columns) and an array of terms for each column; texts go no further."""
    arrays = docs.select(key, *(cut(c).alias(n) for n, c in columns.items()))
    return arrays.withColumn("length", sum((F.size(n) for n in columns), F.lit(0)))


def postings(tokened: DataFrame, key: str, weights: dict[str, float], terms: DataFrame | None = None) -> DataFrame:
    """term, key, tf (weighted) and length; only of ``terms`` if given.

    Terms that no query has are dropped before anything is shuffled.
    """
    columns = [n for n in weights if n in tokened.columns]
    weighted = lambda n: F.transform(n, lambda t: F.struct(t.alias("term"), F.lit(weights[n]).alias("w")))
    each = F.explode(F.concat(*map(weighted, columns)))
    rows = tokened.select(key, "length", each.alias("t")).select(F.col("t.term").alias("term"), key, "length", F.col("t.w").alias("w"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", key, "length").agg(F.sum("w").alias("tf"))


def corpus_stats(tokened: DataFrame) -> DataFrame:
    """One row: documents and mean length of the whole index, whatever a query is limited to."""
    return tokened.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def term_stats(tokened: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """term, df (documents) and tf (uses) over the corpus."""
    each = tokened.select(key, F.explode(F.concat(*columns)).alias("term"))
    return each.groupBy("term", key).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def terms_of(queries: DataFrame, query_id: str, text: str, cut: Callable[[Column], Column] = words) -> DataFrame:
    """query_id and its informative terms, one a row; queries without any have no row."""
    return queries.select(query_id, F.explode(query_terms(F.col(text), cut=cut)).alias("term"))


def search(docs: DataFrame, key: str, columns: dict[str, Column], queries: DataFrame, query_id: str, query_text: str, k: int, weights: dict[str, float] = WEIGHTS, only: DataFrame | None = None, cut: Callable[[Column], Column] = words) -> DataFrame:
    """query_id, rank, key and score of the ``k`` best documents of each query.

    A document matches if it has any of the terms.  Scores are below zero and
    the least is the best; equal scores are ranked by key.  ``only`` (keys)
    limits what is returned and not what is counted.  ``cut`` gives the terms of
    texts and queries alike (``segment.segmenter`` for Han).
    """
    tokened = tokens(docs, key, columns, cut)
    asked = terms_of(queries, query_id, query_text, cut)
    posted = postings(tokened, key, {n: weights[n] for n in columns}, asked)
    often = posted.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(corpus_stats(tokened))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # frequencies join the few query terms, not the postings
    asked = asked.join(often, "term").crossJoin(stats).select(query_id, "term", idf.alias("idf"), "mean")
    if only is not None:
        posted = posted.join(only.select(key), key, "left_semi")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    hits = posted.join(asked, "term").select(query_id, key, (-F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("s"))
    scored = hits.groupBy(query_id, key).agg(F.round(F.sum("s"), 6).alias("score"))
    return top(scored, [query_id], [F.col("score"), F.col(key)], k)


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each group with their rank; Spark keeps k rows of a group on the map side."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
