"""The stored inverted index against a search of the texts themselves."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.operators import bm25, lexical_index
from textloom.operators.lexical_index import LexicalIndex
from textloom.storage import Folder, shared_root



def columns():
    return {"title": F.col("title"), "content": F.col("text")}


@pytest.fixture
def index(spark):
    return LexicalIndex(spark, f"{shared_root(spark)}/test-{uuid.uuid4().hex}", "id", columns())


def docs(spark, seed, ids):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.5)) % 60}" for _ in range(400)]
    rows = [(i, r.choice([None, "", "W1 w2"]), " ".join(r.choices(vocabulary, k=r.randrange(0, 30)))) for i in ids]
    return spark.createDataFrame(rows, "id bigint, title string, text string").withColumns({"range": F.lit("x"), "term": F.lit(1)})


def queries(spark):
    rows = [(1, "w1"), (2, "w3 w59"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (4, "the of"), (5, None), (6, "nowhere"), (7, "w17 w5 w30 w1")]
    return spark.createDataFrame(rows, "q bigint, query string")


def same(spark, index, alive, k=4, only=None):
    want = bm25.search(alive, "id", columns(), queries(spark), "q", "query", k, only=only)
    key = lambda df: sorted(tuple(x) for x in df.select("q", "rank", "id", "score").collect())
    assert key(index.search(queries(spark), "q", "query", k, only)) == key(want)


@pytest.mark.parametrize("few", [0, 6, 100])
def test_index_follows_changes(spark, index, monkeypatch, few):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 5)
    monkeypatch.setattr(lexical_index, "FIRST", 2)
    monkeypatch.setattr(lexical_index, "FEW_TERMS", few)
    first = docs(spark, 1, range(150))
    assert index.backfill(first) and not index.backfill(first)
    same(spark, index, first)
    same(spark, index, first, only=first.where("id % 3 = 0"))
    later = docs(spark, 2, range(100, 200))
    index.replace(later)
    alive = first.where("id < 100").unionByName(later)
    same(spark, index, alive)
    index.delete(alive.where("id % 4 = 1"))
    index.delete(alive.where("id > 1000"))
    alive = alive.where("id % 4 <> 1")
    same(spark, index, alive)
    index.merge()
    assert len(index.state()["segments"]) == 1 and not index.state()["dead"]
    same(spark, index, alive)
    back = docs(spark, 3, [1, 5])
    index.insert(back)
    same(spark, index, alive.unionByName(back))


def test_index_edges(spark, index):
    assert index.search(queries(spark), "q", "query", 3).count() == 0
    index.backfill(docs(spark, 1, []))
    assert index.search(queries(spark), "q", "query", 3).count() == 0
    index.insert(docs(spark, 1, [None, 7]).withColumn("text", F.lit("w1")))
    assert {r["id"] for r in index.search(queries(spark), "q", "query", 3).collect()} == {7}


def test_short_queries_skip_blocks(spark, index, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 4)
    rows = [(i, "", "apple " * (40 if i < 3 else i % 4 == 0) + "pear " * 30) for i in range(400)]
    index.backfill(spark.createDataFrame(rows, "id bigint, title string, text string"))
    read = index.reads(spark.createDataFrame([(1, "apple")], "q bigint, query string"), "q", "query", 2).first()
    assert 0 < read["read"] < read["blocks"] / 2


def test_one_writer_for_each_state(spark):
    folder = Folder(spark, f"{shared_root(spark)}/state-{uuid.uuid4().hex}")
    assert folder.state() == (0, None)
    folder.commit(0, {"a": 1})
    with pytest.raises(RuntimeError):
        folder.commit(0, {"a": 2})
    assert folder.state() == (1, {"a": 1})


def test_tasks_follow_the_postings(spark, index, monkeypatch):
    """What one task sorts or adds up is bounded: more postings make more tasks, while indexing and while searching."""
    monkeypatch.setattr(lexical_index, "TASK_POSTINGS", 40)
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 1)
    alive = docs(spark, 4, range(400))
    index.backfill(alive)
    state = index.state()
    asked = index.asked(queries(spark), "q", "query", state)
    total = asked.agg(F.sum("df")).first()[0]
    found = index.scored(index._all(asked, state), "q", 4, state, index._reads(asked))
    # a slice has 16 ranges, here of one document: with postings enough for as many tasks each has one
    assert total // 40 > 25 and found.rdd.getNumPartitions() == 400 // 16
    files = index._blocks(state).withColumn("file", F.input_file_name())
    postings, most = files.groupBy("file").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert postings > 1000 and most > lexical_index.BUCKETS
    same(spark, index, alive)


def test_scopes(spark, index, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 5)
    alive = docs(spark, 6, range(200))
    index.backfill(alive)
    index.delete(alive.where("id % 5 = 1"))
    alive = alive.where("id % 5 <> 1")
    # a scope may be null, a document may be in two and in none
    scopes = alive.where("id % 7 <> 0").selectExpr("id", "if(id % 3 = 0, null, concat('s', id % 3)) as scope")
    scopes = scopes.unionByName(alive.where("id % 4 = 0").selectExpr("id", "'more' as scope"))
    hits = bm25.search(alive, "id", columns(), queries(spark), "q", "query", 1000).drop("rank").join(scopes, "id")
    want = bm25.top(hits, ["q", "scope"], [F.col("score"), F.col("id")], 3)
    key = lambda df: sorted((tuple(x) for x in df.select("q", "scope", "rank", "id", "score").collect()), key=repr)
    assert key(index.search_scopes(queries(spark), "q", "query", scopes, "scope", 3)) == key(want)


def test_latin_terms_are_those_of_words(spark):
    r = random.Random(2)
    pool = [chr(i) for i in range(1, 256)] + list("\u2010\u2013\u2019\u2026\u20ac") + [" "] * 40 + list("aZ0\u00c9\u00df") * 8
    rows = [(i, "".join(r.choices(pool, k=r.randrange(60)))) for i in range(300)] + [(300, None), (301, "")]
    rows += [(302 + i, f"x{c}Y") for i, c in enumerate(pool)]
    found = spark.createDataFrame(rows, "id bigint, t string").select("id", words(F.col("t")), F.coalesce(F.col("t"), F.lit("")).rlike(lexical_index.OTHER)).orderBy("id").collect()
    sizes, terms = lexical_index.latin_terms([t for _, t in rows])
    flat = [t.decode("latin-1") for t in terms.to_pylist()]
    ends = [0, *sizes.cumsum().tolist()]
    assert not any(x[2] for x in found)
    assert [flat[a:b] for a, b in zip(ends, ends[1:])] == [x[1] for x in found]
    other = spark.createDataFrame([(c,) for c in "\u0100\u200f\u2028\u20ab\u20ad\u4e2d\U0001f600"], "t string")
    assert all(x[0] for x in other.select(F.col("t").rlike(lexical_index.OTHER)).collect())


def test_other_texts_beside_latin_ones(spark, index):
    rows = [(1, "\u0130stanbul w1", "w1 \u4e2d\u6587 w3"), (2, "W1", "\u00c9t\u00e9 w1"), (3, None, "\u03a3\u03bf\u03c6\u03cc\u03c2 w3"), (4, "\u4e2d\u6587", None)]
    alive = spark.createDataFrame(rows, "id bigint, title string, text string")
    index.backfill(alive)
    same(spark, index, alive)
    asked = spark.createDataFrame([(1, "\u4e2d\u6587"), (2, "ETE"), (3, "\u03c3\u03bf\u03c6\u03cc\u03c2")], "q bigint, query string")
    want = bm25.search(alive, "id", columns(), asked, "q", "query", 4)
    assert sorted(map(tuple, index.search(asked, "q", "query", 4).select("q", "rank", "id", "score").collect())) == sorted(map(tuple, want.select("q", "rank", "id", "score").collect()))


def test_range_is_that_of_spark(spark):
    keys = [0, 1, -1, 7, 1 << 62, -(1 << 63), (1 << 63) - 1, *range(1000, 1100)]
    want = [x[0] for x in spark.createDataFrame([(k,) for k in keys], "key bigint").select(F.pmod(F.xxhash64("key"), F.lit(37))).collect()]
    assert lexical_index.range_of(np.array(keys), 37).tolist() == want
