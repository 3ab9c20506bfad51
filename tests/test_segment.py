"""Han text cut by a dictionary: known cases, brute force over all paths, a learned dictionary, searches."""

from __future__ import annotations

import math
import random
from itertools import product

from pyspark.sql import functions as F

from textloom.functions.text import query_terms, words
from textloom.operators import bm25, segment

DICTIONARY = [("如何", 900), ("提升", 500), ("检索", 300), ("准确", 400), ("准确度", 200), ("度", 900), ("提", 300), ("升", 300), ("什么", 900), ("怎么", 700), ("是", 5000), ("用", 2000), (None, 5), ("", 5)]


def test_known_cuts(spark):
    cut = segment.segmenter(spark.createDataFrame(DICTIONARY, "word string, n int"))
    texts = ["如何提升检索准确度", "RRF是什么，怎么用？", "是什么，怎么用？", "What is RRF and how to use it?", None, "", "Größe 检索x检索"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["all"], r["q"]) for r in df.select("i", cut(F.col("t")).alias("all"), query_terms(F.col("t"), cut=cut).alias("q")).collect()}
    assert got[0] == (["如何", "提升", "检索", "准确度"], ["提升", "检索", "准确度"])
    assert [got[i][1] for i in (1, 2, 3)] == [["rrf"], None, ["rrf"]]
    assert got[4] == got[5] == ([], None)
    assert got[6][0] == ["große", "检索", "x", "检索"]


def test_no_dictionary_gives_pairs(spark):
    cut = segment.segmenter(spark.createDataFrame([], "word string, n int"))
    df = spark.createDataFrame([("检索准确度 abc 度",), ("only latin",)], "t string")
    assert all(r["a"] == r["b"] for r in df.select(cut(F.col("t")).alias("a"), words(F.col("t")).alias("b")).collect())


def test_best_path_is_the_best_of_all():
    r = random.Random(3)
    for _ in range(200):
        counts = {"".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 4))): r.randint(1, 500) for _ in range(r.randint(0, 12))}
        run = "".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(1, 8)))
        total, longest = float(sum(counts.values()) or 1), max(map(len, counts), default=1)

        def score(path):
            each = [counts.get(w, 1 if len(w) == 1 else 0) for w in path]
            return sum(math.log(n / total) for n in each) if all(each) else -math.inf

        every = []
        for marks in product((0, 1), repeat=len(run) - 1):
            edges = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
            every.append([run[a:b] for a, b in zip(edges, edges[1:])])
        got = segment.best_path(run, counts, total, longest)
        assert "".join(got) == run and math.isclose(score(got), max(map(score, every)), abs_tol=1e-9)


def test_vocabulary_by_brute_force(spark):
    r = random.Random(4)
    lexicon = ["东西", "南北", "春夏秋", "冬", "山水"]
    texts = ["".join(r.choice(lexicon) for _ in range(30)) + " abc" for _ in range(40)] + [None, "", "latin only"]
    got = {x["word"]: x["n"] for x in segment.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"), bond=3.0).collect()}
    counts: dict[str, int] = {}
    for t in texts:
        run = (t or "").split(" ")[0]
        if run and run[0] > "䷿":
            for m in range(1, 5):
                for i in range(len(run) - m + 1):
                    counts[run[i : i + m]] = counts.get(run[i : i + m], 0) + 1
    total = sum(n for w, n in counts.items() if len(w) == 1)
    kept = {w: n for w, n in counts.items() if len(w) == 1 or n >= 5}
    want = {w: n for w, n in kept.items() if len(w) == 1 or min(n * total / (kept[w[:i]] * kept[w[i:]]) for i in range(1, len(w))) >= 3.0}
    assert got == want and {"东西", "南北", "山水", "春夏秋"} <= set(got)
    assert segment.vocabulary(spark.createDataFrame([], "text string")).count() == 0


def test_search_with_segments(spark):
    cut = segment.segmenter(spark.createDataFrame(DICTIONARY, "word string, n int"))
    docs = spark.createDataFrame([(1, "提升检索准确度"), (2, "什么是用"), (3, "索准"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "如何提升检索准确度")], "q int, t string")
    hits = lambda c: [r["doc_id"] for r in bm25.search(docs, "doc_id", {"content": F.col("text")}, asked, "q", "t", 5, cut=c).orderBy("rank").collect()]
    assert hits(cut) == [1] and set(hits(words)) == {1, 3}
