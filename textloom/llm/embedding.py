"""Exact near-duplicate join of embeddings under a cosine threshold.

Unit vectors with cosine ``c`` or more lie within ``r = sqrt(2 - 2c)`` of each
other.  Within each label, pivots part the vectors into cells, each vector
going to its nearest pivot.  By the triangle inequality, a vector farther from
pivot ``q`` than from its own pivot ``p`` by more than ``2r`` is near nothing in
q's cell; the distance to the plane between ``p`` and ``q``, which in Euclidean
space sharpens that bound, decides whether it is copied to q's cell.  Cells
then join on their own: each vector meets all that may be near it in its home
cell, once.  Cells are cut into blocks of bounded size.

Equal vectors of a label are one class with a count, so that copies are
counted and linked without being compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.util import Workspace, components, spread_join, staged

#: Vectors of a cell, pivots in all (bounds what is broadcast), vectors of a block.
CELL, MOST_PIVOTS, BLOCK = 2000, 4096, 2048
#: Vectors of a cell where there are few, up to 64 pivots in all.
LEAST_CELL = 32
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def deal(pivots, least: float):
    """Rows (rep, n, part, vector) → (part, cell, home, rep, n, vector), copied to the cells where they may have neighbours."""
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            part = batch.column(2).to_numpy(zero_copy_only=False)
            out = [[] for _ in range(6)]
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                x = unit(np.stack([batch.column(3)[int(i)].values.to_numpy(zero_copy_only=False).astype(np.float64) for i in rows]))
                reps = batch.column(0).to_numpy(zero_copy_only=False)[rows]
                n = batch.column(1).to_numpy(zero_copy_only=False)[rows]
                q = known.get(int(p))
                if q is None:
                    home = np.zeros(len(rows), np.int64)
                    near = np.ones((len(rows), 1), bool)
                else:
                    dot = x @ q.T
                    home = dot.argmax(1)
                    gap = np.sqrt(np.maximum(2 - 2 * (q @ q.T), 1e-18))[home]
                    plane = (dot[np.arange(len(rows)), home][:, None] - dot) / gap
                    near = plane <= r + SLACK
                    near[np.arange(len(rows)), home] = True
                at, cell = np.nonzero(near)
                out[0].append(np.full(len(at), p))
                out[1].append(cell)
                out[2].append(home[at] == cell)
                out[3].append(reps[at])
                out[4].append(n[at])
                out[5] += [x[i].tobytes() for i in at]
            if out[0]:
                c = [np.concatenate(o) for o in out[:5]]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1].astype(np.int32)), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(out[5], pa.binary())], names=["part", "cell", "home", "rep", "n", "vector"])

    return work


def join_block(least: float):
    def work(g: pd.DataFrame) -> pd.DataFrame:
        """Links of one block of home vectors with one block of a cell: (rep, links, other)."""
        left, right = g[g.side == 0], g[g.side == 1]
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return none
        a, b = (np.stack([np.frombuffer(v, np.float64) for v in s.vector]) for s in (left, right))
        ra, rb = left.rep.to_numpy(), right.rep.to_numpy()
        dot = a @ b.T
        for i, j in zip(*np.nonzero(np.abs(dot - least) < 1e-12)):
            dot[i, j] = cosine(a[i], b[j])
        hit = (dot >= least) & (ra[:, None] != rb[None, :])
        if not hit.any():
            return none
        links = hit @ right.n.to_numpy()
        # the smallest name around, again and again, names the connected parts of this block
        la, lb, far = ra.copy(), rb.copy(), np.iinfo(np.int64).max
        while True:
            na = np.minimum(la, np.where(hit, lb[None, :], far).min(1))
            nb = np.minimum(lb, np.where(hit, na[:, None], far).min(0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        some, other = hit.any(1), hit.any(0)
        return pd.DataFrame({"rep": np.concatenate([ra[some], rb[other]]), "links": np.concatenate([links[some], np.zeros(other.sum(), np.int64)]).astype(np.int64), "other": np.concatenate([la[some], lb[other]])})

    return work


def near_duplicates(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Null labels, null and zero vectors, and vectors with null or non-finite
    components link with nothing; so do vectors of unlike length.  Rows that
    repeat an id count as vectors of their own in ``n_links``.  A null id links
    with nothing and is its own (null) component.  Further columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"), df[label_col].cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    with Workspace(spark, "embedding") as space:
        # the key of a class: label, and two hashes of the vector
        keyed = rows.where("sound").select("id", "v", F.xxhash64("label", F.size("v")).alias("part"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
        classes = space.staged(keyed.groupBy("part", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "embedding-classes")

        total = classes.count()
        share = min(MOST_PIVOTS, max(total // CELL, min(total // LEAST_CELL, 64))) / max(1, total)
        # about share * m pivots for a part of m classes, chosen by hash
        few = F.pmod(F.xxhash64("part", "h1", "h2"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
        chosen: dict[int, list] = {}
        for r in classes.where(few).select("part", "v").limit(2 * MOST_PIVOTS).collect():
            chosen.setdefault(r["part"], []).append(r["v"])
        pivots = spark.sparkContext.broadcast({p: unit(np.array(sorted(v), np.float64)) for p, v in chosen.items() if len(v) > 1})

        dealt = space.staged(classes.select("rep", "n", "part", "v").mapInArrow(deal(pivots, least), "part bigint, cell int, home boolean, rep bigint, n bigint, vector binary"), "embedding-cells")
        blocks = dealt.groupBy("part", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("homes"), F.ceil(F.count("*") / BLOCK).alias("alls"))
        placed = dealt.join(blocks, ["part", "cell"]).withColumns({"bi": F.pmod(F.xxhash64("rep"), "homes"), "bj": F.pmod(F.xxhash64("rep"), "alls")})
        as_home = placed.where("home").select("part", "cell", "bi", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("bj"), F.lit(0).alias("side"), "rep", "n", "vector")
        as_any = placed.where("homes > 0").select("part", "cell", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("bi"), "bj", F.lit(1).alias("side"), "rep", "n", "vector")
        links = as_home.unionByName(as_any).groupBy("part", "cell", "bi", "bj").applyInPandas(join_block(least), "rep bigint, links bigint, other bigint")
        links = space.staged(links, "embedding-links")

        linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
        whole = components(links, "rep", "other", space).withColumnRenamed("node", "rep")
        told = classes.select("part", "h1", "h2", "rep", "n").join(linked, "rep", "left").join(whole, "rep", "left")
        told = told.select("part", "h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        told = space.staged(told, "embedding-told")
        good = spread_join(keyed.drop("v"), told, ["part", "h1", "h2"], ["id"]).select("id", "n_links", "component_id")
        rest = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        result = staged(good.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")), "embedding-result")
    return result
