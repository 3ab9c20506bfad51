"""The classifiers by held-out accuracy, and the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import MEDIUM, SMALL

from textloom.llm import labelled, pipeline, quality, toxicity, util
from textloom.llm.queries import QUERIES

LARGE = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    p, n = (y > 0.5).sum(), (y <= 0.5).sum()
    return (rank[y > 0.5].sum() - p * (p - 1) / 2) / (p * n)


@pytest.mark.parametrize("name,label,of,out,least", [("op3_quality", "quality", 5, 0, 0.9), ("op7_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out(spark, name, label, of, out, least):
    rows = QUERIES[name](spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) >= least


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, score):
    docs = spark.createDataFrame([(1, None, "s"), (1, "a", "s"), (1, "a", "s"), (None, "b", "s"), (2, "", "s"), (3, "long text " * 100_000, "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert len(score(docs, labels).collect()) == 6
    assert len(score(docs, labels.limit(0)).collect()) == 6
    assert score(docs.limit(0), labels).collect() == []


def test_swapped_groups_score_alike():
    """With the penalty the score of a neutral mention changes less when its group is swapped."""
    bad, good = ["vile scum", "rotten filth", "stupid trash"], ["fine day", "open house", "warm bread"]
    texts, y = [], []
    for i in range(240):
        term = "women" if i % 3 else "muslims"
        texts.append(f"they wrote {term} {(bad if i % 3 else good)[i % 3]} number{i % 7}")
        y.append(float(i % 3 > 0))
    gap = lambda m: abs(float(np.diff(m.scores(*toxicity.coded(["we met women there", "we met men there"])))[0]))
    assert gap(toxicity.train(texts, y, 20.0)) < gap(toxicity.train(texts, y, 0.0))


def labelled_texts(sf_dir, label):
    docs, labels = (pd.read_parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id").dropna(subset=[label]).sort_values("doc_id")
    return list(rows.text.fillna("")), rows[label].to_numpy(float)


def test_penalty_acts_on_the_data():
    """On the driver's texts, which name no group of the fixed list, learned terms make counterfactuals: the penalty
    changes the model and lessens what a swap changes, and no clean text turns toxic for it."""
    texts, y = labelled_texts(MEDIUM, "toxic")
    some = np.arange(len(texts)) % 4 != 2
    fit = lambda penalty: toxicity.train([t for t, k in zip(texts, some) if k], y[some].tolist(), penalty)
    with_it, without = fit(toxicity.PENALTY), fit(0.0)
    assert with_it.named == 0 and with_it.counterfactuals > 100
    assert not np.allclose(with_it.weights, without.weights)
    held = toxicity.coded([t for t, k in zip(texts, some) if not k])
    other = toxicity.coded([toxicity.counterfactual(t, with_it.swaps) for t, k in zip(texts, some) if not k])
    gap = lambda m: np.abs(m.scores(*held) - m.scores(*other)).mean()
    assert gap(with_it) < 0.8 * gap(without)
    wrong = lambda m: ((m.scores(*held) >= 0.3) & (y[~some] < 0.5)).sum()
    assert wrong(with_it) <= wrong(without)


def test_learned_terms_are_alike_and_neutral():
    r = np.random.default_rng(1)
    texts, y = [], []
    for i in range(300):
        group, bad = ("aldans", "borims", "celids")[i % 3], r.random() < 0.4
        texts.append(f"we saw {group} there today" + (" vile scum" if bad else " fine bread"))
        y.append(float(bad))
    found = toxicity.learned_terms(texts, np.array(y))
    assert sorted(found[0]) == ["aldans", "borims", "celids"] and not {"vile", "scum"} & {w for k in found for w in k}
    assert toxicity.counterfactual("Aldans, aldans!", {"aldans": "borims"}) == "Borims, borims!"


@pytest.mark.parametrize("piece", [64, 1000 * 8])
def test_long_texts_score_as_their_pieces(monkeypatch, piece):
    """Pieces of a text give the score of the whole, and a text's neighbours in a batch don't matter."""
    net, r = quality.Network(3), np.random.default_rng(0)
    texts = ["".join(r.choice(list("abc defg\u00e9"), n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 5003)] + ["xyz " * 700]
    each = lambda: np.concatenate([net.scores(*toxicity.coded([t])) for t in texts])
    whole = each()
    assert np.allclose(net.scores(*toxicity.coded(texts)), whole, atol=1e-6)
    monkeypatch.setattr(quality, "PIECE", piece)
    assert np.allclose(each(), whole, atol=1e-6)


def test_words_of_long_texts_hash_as_in_pieces(monkeypatch):
    r = np.random.default_rng(0)
    texts = ["a bb ccc  ddd", "", "   ", "xx" * 200 + " y", "".join(r.choice(list("abc  "), 5000)), "z" * 70_000 + " a", "z" * 70_001]
    data, offsets = toxicity.coded(texts)
    whole = util.word_hashes(data, offsets)
    assert len(set(whole[0][-3:].tolist())) == 3
    monkeypatch.setattr(util, "PIECE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, util.word_hashes(data, offsets)))
    model = toxicity.train(["vile scum here", "fine day"] * 20, [1.0, 0.0] * 20)
    long = "fine word " * 3000 + "scum vile"
    want = model.scores(*toxicity.coded([long]))
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert np.allclose(model.scores(*toxicity.coded([long])), want)


def test_sample_passes_over_what_does_not_fit(spark):
    """A text too long for the bound, or a class that would fill it, leaves room for the rest; ids repeat freely."""
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 10 == 0 else 50)) for i in range(100)] + [(1, "x" * 60)] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "doc_id bigint, b boolean").selectExpr("doc_id", "cast(b as int) as quality")
    texts, y = labelled.sample(docs, labels, "quality", 5, 0, most=4000)
    assert texts == ["x" * 50] or set(map(len, texts)) <= {50, 60}
    assert labelled.sample(docs.limit(0), labels, "quality", 5, 0) == ([], [])


def test_pipeline(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SMALL)
        assert tuple(out.columns) == pipeline.COLUMNS
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert ids[0] >= ids[1] > ids[2] >= ids[3] == ids[4]
    assert len(ids[1]) > 0.5 * len(ids[0])
    packed = pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_pipeline_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), MEDIUM).collect() == []
        stage(spark, odd, MEDIUM).collect()


def test_null_and_repeated_ids_in_the_pipeline(spark):
    """Clean rows with a null id stay, repeated rows stay once, and one id with two texts keeps both."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    row = lambda i, t: (i, t, "en", "s", len(t) if t is not None else None)
    rows = [row(None, text("a")), row(None, text("b")), row(None, text("b")), row(5, text("b")), row(6, text("c")), row(6, text("c")), row(7, text("d")), row(7, text("e")), row(9, text("e")), row(2, ""), row(2, ""), row(2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.one_of_each(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(None, text("a")), (5, text("b")), (6, text("c")), (7, text("d")), (7, text("e")), (2, ""), (2, None)], key=str)
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([row(None, leak), row(None, text("a")), row(3, leak), row(3, text("b"))], docs.schema)
    assert sorted(((r["doc_id"], r["text"]) for r in pipeline.no_benchmark(spark, docs, SMALL).collect()), key=str) == sorted([(None, text("a")), (3, text("b"))], key=str)
