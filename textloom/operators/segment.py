"""Words of Han text: the most likely path through a dictionary of word frequencies.

A dictionary is a parameter: rows (word, n) of a list that the user has, or what
``vocabulary`` learns from a corpus.  It is broadcast, and so bounded by MOST_WORDS.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import HAN, LETTERS, fold, pairs

#: Words that a dictionary may have.
MOST_WORDS = 1_000_000


def best_path(run: str, counts: dict[str, int], total: float, longest: int) -> list[str]:
    """The words whose product of frequencies is largest; of equal paths the one that ends in the longest word.

    A character that no word covers counts as seen once.
    """
    upto, back = [0.0], [0]
    for j in range(1, len(run) + 1):
        best, at = -math.inf, j - 1
        for i in range(max(0, j - longest), j):
            n = counts.get(run[i:j], 1 if j - i == 1 else 0)
            if n and (score := upto[i] + math.log(n / total)) > best:
                best, at = score, i
        upto.append(best)
        back.append(at)
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def with_pairs(path: list[str], counts: dict[str, int]) -> list[str]:
    """A path in which runs of unknown characters are given as overlapping pairs, so that new words are still found."""
    out, unknown = [], ""
    for w in [*path, ""]:
        if w and len(w) == 1 and w not in counts:
            unknown += w
            continue
        if unknown:
            out += [unknown[i : i + 2] for i in range(max(1, len(unknown) - 1))]
            unknown = ""
        if w:
            out.append(w)
    return out


def segmenter(dictionary: DataFrame, word: str = "word", n: str = "n") -> Callable[[Column], Column]:
    """A function from a text column to its terms in order, as ``functions.text.words``, with Han cut by ``dictionary``.

    Null, empty and repeated words count nothing, once and together; counts
    below one count as one.  An empty dictionary gives pairs everywhere.  A
    null text has no terms.  Texts without Han never leave the JVM.
    """
    rows = dictionary.where(F.length(word) > 0).groupBy(F.lower(word).alias("w")).agg(F.greatest(F.sum(n), F.lit(1)).cast("long").alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary may have {MOST_WORDS} words at most")
    counts = {r["w"]: r["n"] or 1 for r in rows}
    known = dictionary.sparkSession.sparkContext.broadcast((counts, float(sum(counts.values()) or 1), max(map(len, counts), default=1)))

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        counts, total, longest = known.value

        def one(parts) -> list[str] | None:
            if parts is None:
                return None
            out = []
            for han, run in ((r["han"], r["run"]) for r in parts):
                out += with_pairs(best_path(run, counts, total, longest), counts) if han else [run]
            return out

        return runs.map(one)

    def terms(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        runs = F.regexp_extract_all(fold(text), F.lit(rf"[{LETTERS}]+|[{HAN}]+"), F.lit(0))
        told = F.transform(runs, lambda r: F.struct(r.rlike(f"^[{HAN}]").alias("han"), r.alias("run")))
        has_han = text.rlike(f"[{HAN}]")
        return F.when(has_han, cut(F.when(has_han, told))).otherwise(runs)

    return terms


def vocabulary(df: DataFrame, text: str = "text", longest: int = 4, least: int = 5, bond: float = 8.0) -> DataFrame:
    """(word, n): characters of Han runs, and sequences of up to ``longest`` of them that hold together.

    A sequence is a word if it occurs ``least`` times and, however it is parted
    in two, ``bond`` times as often as its parts would meet by chance.  All texts
    are counted; null texts have no runs.
    """
    runs = df.select(F.explode(F.regexp_extract_all(fold(F.coalesce(df[text].cast("string"), F.lit(""))), F.lit(f"[{HAN}]+"), F.lit(0))).alias("run"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(longest))), lambda m: F.transform(F.sequence(F.lit(1), F.length("run") - m + 1), lambda i: F.substring(F.col("run"), i, m))))
    counted = runs.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    kept = counted.where((F.length("word") == 1) | (F.col("n") >= least))
    total = counted.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")
    parted = kept.where(F.length("word") > 1).select("word", "n", at).select("word", "n", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    part = lambda p: kept.select(F.col("word").alias(p), F.col("n").alias("n" + p))
    held = parted.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total))
    strong = held.groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("bond"))
    return kept.where(F.length("word") == 1).unionAll(strong.where(F.col("bond") >= bond).select("word", "n"))
