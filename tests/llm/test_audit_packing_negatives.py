"""Filter audit, configuration packing and hard negatives against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import config_packing, filter_audit, hard_negatives
from textloom.llm.queries import WORD_TOKENIZER, op12_config_packing

# ------------------------------------------------------------ filter audit


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n) == 1 + sum(1 for _ in filter_audit.transpositions(n))


def fails(docs):
    found = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        found.append({k for k, v in own.items() if v})
    return found


def audited(docs, labels):
    rows, failed = set(), fails(docs)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    for part in {s or "" for *_, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, failed) if (s or "") == part]
        own = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                own.append((part, order, step, len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        total = {f: sum(x[4] for x in own if x[-1] == f) for f in "ABCDE"}
        rows |= {(*x[:-1], total[x[-1]]) for x in own}
    return rows


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr("textloom.llm.util.HOT_ROWS", 5)  # equal texts are spread
    texts = [None, "", " ", "A", "a b $", "one two " * 30, " ".join(f"w{i}" for i in range(60)), "X" * 300, "ein wort \u000b#", "ÄÖ é " * 40]
    docs = [(r.choice([None, *range(40)]), r.choice(texts) if r.random() < 0.7 else " ".join(r.choice("abcXY&") for _ in range(r.randrange(90))), r.choice(["s1", "s2", "", None])) for _ in range(150)]
    labels = [(r.choice([None, *range(40)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit("x"), "docs": F.lit(2), "digest": F.lit(0)})
    got = filter_audit.audit_documents(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = [tuple(x) for x in got.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audited(docs, labels)


def test_audit_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_documents(none, marks).count() == 0
    one = filter_audit.audit(spark.range(3), F.lit("p"), {"Z": F.col("id") > 1, "Y": F.lit(None)}, {"lost": F.col("id") == 2}).collect()
    assert {(x["filter_order"], x["step"], x["kept"], x["removed"], x["lost"], x["shapley"]) for x in one} == {("ZY", 1, 2, 1, 1, 2), ("ZY", 2, 2, 0, 0, 0), ("YZ", 1, 3, 0, 0, 0), ("YZ", 2, 2, 1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(spark.range(3), F.lit("p"), {}, {})


# --------------------------------------------------- configuration packing


def whole(docs, rows, tokenizer, capacity):
    """The pieces are the documents' ids, cut at multiples of the capacity, and sequences have no gap; sequences used."""
    want = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(want, key=key) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(x[3] for x in want) // capacity)


ODD = [None, "", " ", "\n\t", "Hello, WORLD!  it's 42% <|endoftext|>x <|STARTOFTEXT|>", "a b\u0085c\x1cd", "é ́ ΟΔΟΣ İ", "(quoted) 'd 'll", "漢字かな x-y", "\U0001f600 \x00 -- .,;", "<|endoftext|> |endoftext| (<|endoftext|>) ((ÄB)) é́, ##x## a'b' 'S, ŒUVRE! ǅ.", "zz" * 3000, "w " * 5000]


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_config_packing_of_odd_texts(spark, capacity):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"length": F.lit("x"), "cell": F.lit(1)}).repartition(3)
    whole(docs, config_packing.pack_documents(df, WORD_TOKENIZER, capacity=capacity).collect(), Tokenizer.from_file(WORD_TOKENIZER), capacity)
    assert config_packing.pack_documents(df.limit(0), WORD_TOKENIZER).count() == 0


def test_config_packing_with_ids(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id bigint, text string")
    for r in config_packing.pack_documents(df, WORD_TOKENIZER, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_config_packing_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    used, least = whole(docs, op12_config_packing(spark, MEDIUM).collect(), Tokenizer.from_file(WORD_TOKENIZER), 2048)
    assert used <= 1.005 * least + 1


def best(lengths, capacity):
    """Least sequences, tried out."""
    lengths, found = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(lengths):
            found[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                go(i + 1, bins)
                bins[b] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_near_the_best(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 16, 31])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 11))]
    plan = config_packing.planned(np.bincount(lengths, minlength=capacity + 1))
    held = sum((np.array([c.get(k, 0) for k in range(capacity + 1)]) * t for c, t in plan.uses), np.zeros(capacity + 1, int))
    assert held.tolist() == np.bincount(lengths, minlength=capacity + 1).tolist()
    assert all(sum(k * n for k, n in c.items()) <= capacity for c, _ in plan.uses)
    assert plan.bound <= best(lengths, capacity) <= plan.sequences <= best(lengths, capacity) + 1


def test_program_fills_most_sequences_and_says_how_near_the_best_it_is():
    demand = np.zeros(513, np.int64)
    noise = np.random.default_rng(1).integers(1, 10**9, 511)
    demand[1:512] = noise / np.arange(1, 512)
    plan = config_packing.planned(demand)
    assert plan.sequences <= 1.002 * plan.bound and plan.by_program > 0.8 * plan.sequences
    # as many long pieces as short ones: half of the sequences are forced apart
    demand[1:512] = noise
    plan = config_packing.planned(demand)
    assert plan.sequences <= 1.03 * plan.bound
    # lengths of which no two fit together: the bound of the program, not that of the sizes
    demand[:] = 0
    demand[300] = 1000
    assert config_packing.planned(demand).bound == 1000


# ---------------------------------------------------------- hard negatives


def mined(rows, positives=5, negatives=3):
    sound = {(i, y, tuple(v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, y, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, y, v in sound]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(a, b)))
    out = set()
    for i in {x[0] for x in q if x[0] % 50 == 0}:
        _, y, v = min((x for x in q if x[0] == i), key=lambda x: (x[1], x[2]))
        scored = sorted((-dot(v, w), j, z) for j, z, w in q if j != i)
        for s, j, z in [x for x in scored if x[2] == y][:positives]:
            hard = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out |= {(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(hard, 1)}
    return out


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("kind", ["even", "ties", "norms", "huge"])
def test_hard_negatives(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 3), ("STRIPE", 70), ("BUCKET", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    if kind == "ties":
        x = np.round(x) / 8
    if kind == "norms":
        x *= r.lognormal(0, 2, size=(300, 1))
    if kind == "huge":
        x *= 1e12
    rows = [(i, v.astype(np.float32).tolist(), int(y)) for i, (v, y) in enumerate(zip(x, r.integers(0, 3, 300)))]
    rows += [(50, None, 1), (None, [1.0] * 6, 1), (301, [1.0] * 6, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [math.inf] * 6, 1), (304, [math.nan] * 6, 1), (305, [0.0] * 6, 2), (350, [0.0] * 6, 2), (306, [1.0, 2.0], 1), (400, [], 0), *rows[40:60], *[(900 + k % 2, [0.5] * 6, k % 3) for k in range(60)]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"id": F.lit("x"), "score": F.lit(1), "v": F.lit(2)})
    got = [tuple(x) for x in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).select(NEGATIVE).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_buckets_out_of_reach_are_not_scored():
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(4000, 8)) * 100 / np.arange(1, 4001)[:, None] ** 0.7)
    side = {"id": np.arange(4000), "label": np.zeros(4000, int), "v": v}
    asked = {k: x[:20] for k, x in side.items()}
    counts = {}
    hard_negatives.searched(asked, side, [(np.full(20, -np.inf), np.full(20, np.inf))], 5, True, counts)
    assert counts["pairs"] < 0.3 * 20 * 4000


# ------------------------------------------------ words that are encoded together


class _Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def _encoded(texts):
    words = config_packing.WordIds(WORD_TOKENIZER)
    words.tokenizer = counting = _Counting(words.tokenizer)
    raw = [t.encode() for t in texts]
    ids, edges = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return counting.texts, [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


def test_words_of_letters_are_encoded_together():
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefgh\u00e9\u00c9\u00f1", k=r.randrange(1, 9))) for _ in range(200)) for _ in range(20)]
    texts += ["", " ", "ab", "cd\x0bef\x1cgh \u00a0 x", "end ", "\tfirst"]
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    calls, found = _encoded(texts)
    assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls < len({w for t in texts for w in t.split()}) / 20


def test_letters_of_several_pieces_fall_back():
    """A capital I with a dot becomes a letter and a mark, which are two pieces."""
    texts = ["abc \u0130stanbul d\u0130 efg", "abcdefg \u0149a h"]
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    assert _encoded(texts)[1] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
