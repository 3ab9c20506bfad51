"""Nearest neighbours by cosine: exact, for any number of queries, and approximate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.bm25 import top

#: Queries that are broadcast (beyond that, blocks of queries and vectors are joined), and vectors of a block.
MOST_QUERIES, BLOCK = 4096, 4096
#: Buckets next to its own that a query is also looked up in, in each table of the approximate index.
PROBES = 2


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, met: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest in this block, ties by id; of the candidates alone where ``met`` tells them."""
    s = np.round(np.maximum(q @ x.T, 0), 6)
    if met:
        s[~met(q, x)] = -1
    order = np.argsort(ids, kind="stable")
    ids, s = ids[order], s[:, order]
    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
    s = np.take_along_axis(s, at, 1)
    told = s >= 0
    return np.repeat(q_ids, told.sum(1)), ids[at][told], s[told]


def exact(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, key: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, rank, key and score (cosine, zero at least, six places) of the k nearest vectors.

    The limit comes first, then scores below the threshold are dropped; since
    the score falls with the rank the order makes no difference.  Null vectors
    are left out.
    """
    return _nearest(vectors, queries, k, threshold, key, vector, query_id, query_vector)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, key: str, vector: str, query_id: str, query_vector: str, met: Callable | None = None) -> DataFrame:
    vectors = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    queries = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias(query_id), F.col(query_vector).cast("array<double>").alias(query_vector))
    few = queries.limit(MOST_QUERIES + 1).collect()
    schema = f"{query_id} bigint, {key} bigint, score double"
    if not few:
        return vectors.sparkSession.createDataFrame([], f"{query_id} bigint, {key} bigint, score double, rank int")
    if len(few) <= MOST_QUERIES:
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few]), _unit([r[1] for r in few])))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                ids, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                for a in range(0, len(ids), BLOCK):
                    part = col.slice(a, BLOCK)
                    x = _unit(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(q_ids, q, ids[a : a + BLOCK], x, k, met)], names=[query_id, key, "score"])

        near = vectors.mapInArrow(work, schema)
    else:
        n_q = max(1, queries.count() // BLOCK + 1)
        n_v = max(1, vectors.count() // BLOCK + 1)
        left = queries.select(F.pmod(F.xxhash64(query_id), F.lit(n_q)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("j"), F.lit(0).alias("side"), F.col(query_id).alias("id"), F.col(query_vector).alias("v"))
        right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), F.pmod(F.xxhash64(key), F.lit(n_v)).alias("j"), F.lit(1).alias("side"), F.col(key).alias("id"), F.col(vector).alias("v"))

        def block(g: pd.DataFrame) -> pd.DataFrame:
            a, b = g[g.side == 0], g[g.side == 1]
            if not len(a) or not len(b):
                return pd.DataFrame({query_id: [], key: [], "score": []}).astype({query_id: "int64", key: "int64"})
            q, i, s = _best(a.id.to_numpy(), _unit(a.v.tolist()), b.id.to_numpy(), _unit(b.v.tolist()), k, met)
            return pd.DataFrame({query_id: q, key: i, "score": s})

        near = left.select("i", F.col("j").cast("long").alias("j"), "side", "id", "v").unionByName(right.select(F.col("i").cast("long").alias("i"), "j", "side", "id", "v")).groupBy("i", "j").applyInPandas(block, schema)
    return top(near, [query_id], [F.desc("score"), F.col(key)], k).where(F.col("score") >= threshold)


def _buckets(x: np.ndarray, planes: np.ndarray, probes: int = 0) -> np.ndarray:
    """Buckets of each vector in each table: that of its signs, and ``probes`` with one sign turned, of the planes nearest to it."""
    far = np.einsum("nd,tbd->ntb", x, planes)
    turn = 1 << np.argsort(np.abs(far), axis=2, kind="stable")[:, :, :probes]
    own = ((far > 0) * (1 << np.arange(planes.shape[1]))).sum(2)[:, :, None]
    return np.concatenate([own, own ^ turn], axis=2)


def _met(q: np.ndarray, x: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """Whether a query (row) and a vector (column) share a bucket in any table."""
    asked, held = _buckets(q, planes, probes), _buckets(x, planes)[:, :, 0]
    met = np.zeros((len(q), len(x)), bool)
    for t in range(len(planes)):
        codes, at = np.unique(asked[:, t], return_inverse=True)
        looked = np.zeros((len(q), len(codes) + 1), bool)
        looked[np.arange(len(q))[:, None], at.reshape(len(q), -1)] = True
        place = np.searchsorted(codes, held[:, t])
        place[np.append(codes, -1)[place] != held[:, t]] = len(codes)
        met |= looked[:, place]
    return met


def approximate(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 24, bits: int = 6, key: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", probes: int = PROBES, seed: int = 3) -> DataFrame:
    """As ``exact``, from candidates whose bucket of hyperplane signs is the
    query's own or one of the ``probes`` next to it, in any of the tables.

    Blocks look their own vectors up in the queries' buckets and give their k
    best candidates, so that neither copies of vectors nor pairs are dealt out.
    """
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    return _nearest(vectors, queries, k, 0.0, key, vector, query_id, query_vector, lambda q, x: _met(q, x, planes, probes))
