"""The Jaccard join, the embedding join and components against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import embedding, jaccard, util
from textloom.llm.util import Workspace, components


def parts(nodes, links):
    """Smallest node reachable from each."""
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        u, v = top(a), top(b)
        above[max(u, v)] = min(u, v)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    for size, links in ((50, 30), (300, 280), (200, 0)):
        edges = [(r.randrange(size), r.randrange(size)) for _ in range(links)] + [(i, i + 1) for i in range(1000, 1000 + links)]
        want = parts({x for e in edges for x in e}, edges)
        df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a bigint, b bigint")
        got = {x["node"]: x["component"] for x in components(df, "a", "b").collect()}
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {n: c for n, c in want.items() if n in touched}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    whole = parts(sets, links)
    return {(i, len(sets[i]), whole[i]) for i in sets}


def near_copies(seed, groups=6, copies=25):
    """Groups of copies edited lightly and heavily, passages that many share, exact copies, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice((8, 40, 120, 300)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 5, 8))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w[at:at] = passage[: r.choice((10, 30, 60))]
            texts.append(r.choice((" ", "\n", "\t ")).join(w))
    texts += ["one two", "One TWO", "one  two\n", "", None, "   ", "x", "É a b c d e", "é a b c d e", "word " * 3000]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed, monkeypatch):
    if seed == 2:  # many blocks for each cell
        monkeypatch.setattr(jaccard, "CELL_DOCS", 3)
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id bigint, text string, doc string, n int")
    got = {tuple(x) for x in jaccard.link_documents(df).collect()}
    assert got == brute(rows)


def test_unlike_words_link_nothing(spark):
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, first), (2, first.translate({97: "b", 98: "a"})), (3, "w x y z " + first), (4, "w x y z " + first.translate({97: "b", 98: "a"}))]
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_jaccard_edges(spark):
    schema = "doc_id bigint, text string"
    assert jaccard.link_documents(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "a b c d e f")]
    got = sorted((tuple(x) for x in jaccard.link_documents(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (3, 2, 1)], key=repr)


def vectors(seed):
    r = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        centres = r.normal(size=(4, 16))
        for i in range(120):
            rows.append((list(map(float, (centres[i % 4] + r.normal(size=16) * r.choice([0.05, 0.2, 0.4])).astype(np.float32))), label))
    rows += [(rows[0][0], 0)] * 5 + [(rows[0][0], 1), (rows[0][0], None), ([0.0] * 16, 0), ([0.0] * 16, 0), (None, 0), ([math.nan] + [1.0] * 15, 0), ([math.inf] * 16, 0), ([None] + [1.0] * 15, 0), ([], 0), ([2 * x for x in rows[0][0]], 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def brute_vectors(rows, least=0.93):
    sound = [(i, np.array(v, np.float64), label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x, p) in enumerate(sound) for b, y, q in sound[k + 1 :] if p == q and float(x @ y / math.sqrt((x @ x) * (y @ y))) >= least]
    whole = parts([i for i, _, _ in rows], links)
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, n[i], whole[i], whole[i] == i) for i in n}


@pytest.mark.parametrize("cell,block", [(2000, 2048), (10, 7)])
def test_embedding_join(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "BLOCK", block)
    rows = vectors(3)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id bigint, embedding array<float>, label int, part string, cell double")
    assert {tuple(x) for x in embedding.near_duplicates(df).collect()} == brute_vectors(rows)


def test_embedding_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embedding.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = sorted((tuple(x) for x in embedding.near_duplicates(spark.createDataFrame([(1, [1.0], 1), (1, [1.0], 1), (None, [1.0], 1)], schema)).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)], key=repr)


def test_every_link_is_a_candidate_of_the_prefixes(spark):
    """Linked pairs of unlike sets share as many prefix tokens as the smaller of both asks for; leaders find most of them."""
    rows = near_copies(5, 2, 60)
    docs = spark.createDataFrame([(i, t) for i, t in rows if t], "doc bigint, text string")
    with Workspace(spark, "test") as space:
        known = docs.mapInArrow(jaccard.full_sets, "doc bigint, s1 bigint, n int, set array<bigint>").where("n > 0").dropDuplicates(["s1"])
        profile = jaccard.profiled(space.staged(known, "known"), space)
        told = {r["doc"]: (r["k"], set(r["prefix"])) for r in profile.collect()}
        posting = space.staged(profile.select(F.explode("prefix").alias("token"), "doc", "k"), "posting")
        led = {frozenset(x) for x in jaccard.verify(space.staged(jaccard.met(posting), "met"), profile).collect()}
        kept = {r["doc"] for r in known.select("doc").collect()}
    sets = {i: shingles(t) for i, t in rows if i in kept}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 100 and any(k > 1 for k, _ in told.values())
    for a, b in links:
        (ka, pa), (kb, pb) = told[a], told[b]
        assert len(pa & pb) >= min(ka, kb)
    assert led <= {frozenset(x) for x in links}
    by_prefix, whole = parts(sets, [tuple(x) for x in led]), parts(sets, links)
    assert sum(by_prefix[i] != i for i in sets) > sum(whole[i] != i for i in sets) / 2


def test_flood_of_equal_texts_makes_bounded_rows(spark):
    """Two million rows of one text, or of none, are handed on in rows of bounded length."""
    for text in ("a b c d e f g", None):
        made = (pa.RecordBatch.from_arrays([pa.array(range(i, i + 10_000), pa.int64()), pa.array([text] * 10_000, pa.string())], names=["doc", "text"]) for i in range(0, 2_000_000, 10_000))
        lengths = [len(docs) for batch in jaccard.screened(made) for docs in batch.column(4).to_pylist() if docs]
        assert sum(lengths) == 2_000_000 and max(lengths) <= jaccard.SLICE_DOCS + 10_000


def test_jaccard_hot_text_and_tokens(spark, monkeypatch):
    """Texts and passages that all slices have: spread joins and tokens read ahead give what brute force does."""
    monkeypatch.setattr(jaccard, "AHEAD", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "CELL_DOCS", 3)
    monkeypatch.setattr(util, "HOT_ROWS", 3)
    rows = near_copies(7, 3, 30)
    rows += [(1000 + i, "one text that a third of all rows hold " + "again " * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    assert {tuple(x) for x in jaccard.link_documents(df).collect()} == brute(rows)


def test_jaccard_id_with_two_texts(spark):
    """The texts of one id join what each of them is linked with; other columns are ignored."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a, 0), (5, b, 0), (3, a, 0), (9, b, 0), (7, "x y z", 0)]
    got = sorted(tuple(x) for x in jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string, part int")).collect())
    assert got == [(3, 4, 3), (5, 4, 3), (5, 4, 3), (7, 1, 7), (9, 4, 3)]


def test_no_plan_grows_by_joins_within_joins(spark, monkeypatch):
    """What the driver plans at once stays small: no stage holds both stars of a round, and without edges there is none."""
    sizes, stage = [], util._stage

    def counted(df, path):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return stage(df, path)

    monkeypatch.setattr(util, "_stage", counted)
    components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a bigint, b bigint"), "a", "b").collect()
    assert max(sizes) < 60
    sizes.clear()
    assert components(spark.createDataFrame([(5, 5), (None, 1)], "a bigint, b bigint"), "a", "b").collect() == []
    assert len(sizes) == 1
    sizes.clear()
    rows = near_copies(3, 2, 8)
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(x) for x in got} == brute(rows)
    assert max(sizes) < 100


def test_hot_keys_beyond_their_bound(spark, monkeypatch):
    """Facts of a hot key that isn't among the spread ones meet each row once."""
    monkeypatch.setattr(util, "HOT_ROWS", 2)
    monkeypatch.setattr(util, "HOT_KEYS", 1)
    rows = spark.createDataFrame([(k, i) for k in range(3) for i in range(4 + 3 * k)], "k bigint, i bigint")
    facts = rows.groupBy("k").agg(F.max("i").alias("top"), F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = util.spread_join(rows, facts, ["k"], ["i"], how=how)
        assert sorted(map(tuple, got.select("k", "i", "top").collect())) == [(k, i, 3 + 3 * k) for k in range(3) for i in range(4 + 3 * k)]
        assert "n" not in got.columns
