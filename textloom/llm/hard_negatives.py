"""Hard negatives of anchors within a window of their positives' scores.

Scores are inner products of whole numbers.  Candidates are dealt to stripes;
within a stripe they are sorted by norm and cut into buckets.  By
Cauchy-Schwarz no candidate of a bucket scores more than the anchor's norm
times the bucket's largest, and norms fall from bucket to bucket: a bucket
that can't reach an anchor's running kth score, nor its window's lower limit,
ends that anchor's search of the stripe.  Anchors meet candidates in blocks of
bounded size; what the stripes found is merged by anchor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.util import Workspace, staged

#: Anchors of a block, candidates of a stripe and of a bucket.
BLOCK, STRIPE, BUCKET = 2048, 4096, 512
#: Window of a negative's score, in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Sums up to this are exact as doubles, also when multiplied by a hundred.
EXACT = 2**53 // 128
LONG = 2**63 - 1


class Scores:
    """Inner products of whole vectors: as doubles where these are exact, else as Python's integers, kept within a long."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        most = lambda x: float(np.abs(x).max()) if x.size else 0.0
        self.wide = most(a) * most(b) * max(1, a.shape[1]) >= EXACT
        whole = (lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)) if self.wide else (lambda x: x)
        self.a, self.b = whole(a), whole(b)

    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = self.a[i] @ self.b[j].T
        return np.minimum(np.maximum(s, -LONG - 1), LONG) if self.wide else s


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def norm(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, never too small."""
    most = np.abs(x).max(1, initial=1.0)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1)) * (1 + 1e-9)


def first(s: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best allowed columns of each row, -inf where there are fewer.

    Columns are in the order of ids, so that the first of equals is the least.
    """
    s = np.where(allowed, s, -np.inf)
    rows, top, who = np.arange(len(s)), [], []
    for _ in range(k):
        at = s.argmax(1)
        top.append(s[rows, at])
        who.append(ids[at])
        s[rows, at] = -np.inf
    return np.stack(top, 1), np.stack(who, 1)


def merged(s: np.ndarray, i: np.ndarray, t: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists in each row, ties by id."""
    s, i = np.concatenate([s, t], 1), np.concatenate([i, j], 1)
    by_id = np.argsort(i, 1, kind="stable")
    s, i = np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1)
    best = np.argsort(-s, 1, kind="stable")[:, :k]
    return np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def searched(anchors: dict, stripe: dict, windows: list[tuple[np.ndarray, np.ndarray]], k: int, same: bool, counts: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lower, upper bounds of 100 x score for each anchor) the
    (scores, ids) of the k best candidates of the stripe in it, of the anchor's
    label or of any other.  ``counts`` gets the pairs that were scored.
    """
    scores = Scores(anchors["v"], stripe["v"])
    reach, far = norm(anchors["v"]), norm(stripe["v"])
    by_norm = np.argsort(-far, kind="stable")
    n = len(reach)
    kind = object if scores.wide else np.float64
    found = [(np.full((n, k), -np.inf, kind), np.zeros((n, k), np.int64)) for _ in windows]
    for a in range(0, len(by_norm), BUCKET):
        at = by_norm[a : a + BUCKET]
        bound = np.nan_to_num(reach * far[at[0]] + 1e-6, nan=np.inf)
        # no more of this stripe for a window whose limit or kth score is out of reach
        open_ = [(100 * bound >= low) & (bound >= s[:, -1]) & (low <= high) for (low, high), (s, _) in zip(windows, found)]
        rows = np.flatnonzero(np.any(open_, 0))
        if not len(rows):
            break  # norms fall: no later bucket reaches further
        at = at[np.argsort(stripe["id"][at], kind="stable")]
        s = scores.block(rows, at)
        ids, hundred = stripe["id"][at], 100 * s
        if counts is not None:
            counts["pairs"] = counts.get("pairs", 0) + s.size
        fits = (anchors["label"][rows][:, None] == stripe["label"][at][None, :]) == same
        fits &= anchors["id"][rows][:, None] != ids[None, :]
        for w, (low, high) in enumerate(windows):
            own = open_[w][rows]
            if not own.any():
                continue
            r = rows[own]
            allowed = fits[own] & (hundred[own] >= low[r][:, None]) & (hundred[own] <= high[r][:, None])
            found[w][0][r], found[w][1][r] = merged(found[w][0][r], found[w][1][r], *first(s[own], allowed, ids, k), k)
    return found


def limits(scores: pd.Series, place: int, times: int, none: float, kind: type) -> np.ndarray:
    """Each anchor's score at a place, times a number of hundredths; ``none`` where it has no such score."""
    return np.array([times * int(s[place]) if place < len(s) else none for s in scores], kind)


def _sides(g: pd.DataFrame) -> tuple[pd.DataFrame, dict, dict]:
    left, right = g[g.side == 0], g[g.side == 1]
    width = max((len(v) for v in g.v), default=0)
    side = lambda x: {"id": x.id.to_numpy(), "label": x.label.to_numpy(), "v": matrix(x.v, width)}
    return left, side(left), side(right)


def _rows(anchor: np.ndarray, slot: int, s: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    told = s > -np.inf
    return pd.DataFrame({"anchor_id": np.repeat(anchor, told.sum(1)), "slot": slot, "id": ids[told], "score": np.array([int(x) for x in s[told]], np.int64)})


def _none() -> pd.DataFrame:
    return _rows(np.zeros(0, np.int64), 0, np.zeros((0, 1)), np.zeros((0, 1), np.int64))


def mine(
    df: DataFrame, is_anchor, label=None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, least: int = LEAST, most: int = MOST, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the rows and ``label`` what stands for the
    label column.  Components become ``floor(scale * x)``, scores are inner
    products of these, the higher first, ties by smaller id.  The positives of
    an anchor are its best rows of the same label; for each of them the best
    rows of other labels whose score is ``least`` to ``most`` hundredths of the
    positive's are its negatives.

    Rows with a null id or label, a null vector, or a null or non-finite
    component take no part.  Of equal rows (id, label, components) one counts;
    of several anchor rows of one id that with the least label and vector is the
    anchor, and rows of an anchor's own id are never its positives or negatives.
    Vectors of unlike length count as if the shorter ended in zeros.  Scores
    beyond a long count as the nearest long, components that overflow when
    scaled as non-finite.  An empty table gives an empty table, further columns
    are ignored.
    """
    spark = df.sparkSession
    number = F.col(id_col).cast("long")
    v = F.col(vector_col).cast("array<double>")
    kind = (F.col(label_col) if label is None else label).cast("long")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(number.isNotNull() & F.col(label_col).isNotNull() & finite, F.lit(False))
    # floor() of a double is a long, which large components don't fit in
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = df.where(sound).select(number.alias("id"), kind.alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    with Workspace(spark, "negatives") as space:
        rows = space.staged(rows.dropDuplicates(["id", "label", "v"]), "vectors")
        n = rows.agg(F.count("*"), F.count_if("asked")).first()
        stripes, blocks = max(1, -(-n[0] // STRIPE)), max(1, -(-n[1] // BLOCK))
        # an id stands for one anchor
        anchors = rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
        # a stated set of anchors against all rows: every block of anchors meets every stripe
        dealt = lambda c, m: F.pmod(F.xxhash64("id", "label", "v"), F.lit(m)).cast("int").alias(c)
        every = lambda c, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c)
        candidates = rows.select(every("i", blocks), dealt("j", stripes), F.lit(1).alias("side"), "id", "label", "v")
        schema = "anchor_id bigint, slot int, id bigint, score bigint"

        def met(asked: DataFrame, others: DataFrame, work) -> DataFrame:
            both = asked.unionByName(others, allowMissingColumns=True)
            return both.groupBy("i", "j").applyInPandas(work, schema)

        def best_same(g: pd.DataFrame) -> pd.DataFrame:
            left, a, b = _sides(g)
            out = [_none()]
            for one in np.unique(a["label"]):
                mine_, theirs = ({c: x[side["label"] == one] for c, x in side.items()} for side in (a, b))
                if len(theirs["id"]):
                    anything = (np.full(len(mine_["id"]), -np.inf), np.full(len(mine_["id"]), np.inf))
                    out.append(_rows(mine_["id"], 0, *searched(mine_, theirs, [anything], positives, True)[0]))
            return pd.concat(out)

        def best_other(g: pd.DataFrame) -> pd.DataFrame:
            left, a, b = _sides(g)
            out = [_none()]
            if len(left) and len(b["id"]):
                told = [int(x) for s in left.positive for x in s]
                kind = np.float64 if not told or max(map(abs, told)) < EXACT else object
                windows = [(limits(left.positive, p, least, np.inf, kind), limits(left.positive, p, most, -np.inf, kind)) for p in range(positives)]
                out += [_rows(a["id"], p, *f) for p, f in enumerate(searched(a, b, windows, negatives, False))]
            return pd.concat(out)

        def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
            w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
            return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

        asked = anchors.select(dealt("i", blocks), every("j", stripes), F.lit(0).alias("side"), "id", "label", "v")
        near = space.staged(ranked(met(asked, candidates, best_same), ["anchor_id"], positives), "positives")
        # what an anchor looks for: a few scores
        wanted = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positive"))
        windowed = asked.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
        far = ranked(met(windowed, candidates.withColumn("positive", F.lit(None).cast("array<bigint>")), best_other), ["anchor_id", "slot"], negatives)
        pairs = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = pairs.join(far.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "slot"])
        return staged(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-result")
