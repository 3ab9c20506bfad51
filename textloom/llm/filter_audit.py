"""What each filter of a sequence removes, for every order of the filters.

Documents become masks, a bit for each filter that they fail, and masks become
cells: counts for each part of the corpus and each mask, 2^k of them at most
for k filters.  All orders are then visited by swaps of neighbours, each order
once.  A swap at a place alters what the two filters there remove and nothing
else, so that two sums over the cells replace a pass over the corpus; Shapley
values add up along the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.util import Workspace, spread_join, staged

#: Filters at most: beyond, orders are too many to be listed.
MOST_FILTERS = 8
#: Parts that are walked at once.
PARTS = 64


def transpositions(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i+1) that lead from one order of ``n`` things through all others, each once.

    The last thing wanders through an order of the rest, which then makes one swap of its own.
    """
    if n < 2:
        return
    down = True
    rest = transpositions(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        inner = next(rest, None)
        if inner is None:
            return
        yield inner + (1 if down else 0)
        down = not down


class Walk:
    """Counts of all orders for several parts at once.

    ``cells`` is (parts, 2^k, counters); the first counter is the documents'.
    """

    def __init__(self, cells: np.ndarray, k: int):
        self.cells, self.k, masks = cells, k, np.arange(1 << k)
        self.fails = [(masks >> f & 1).astype(bool) for f in range(k)]
        self.masks = masks
        self.total = cells[:, :, 0].sum(1)
        self.failing = [cells[:, m, 0].sum(1) for m in self.fails]
        self.unique = [cells[:, 1 << f, 0] for f in range(k)]

    def _removed(self, f: int, before: int) -> np.ndarray:
        """What filter ``f`` removes after the filters of the mask ``before``: (parts, counters)."""
        return self.cells[:, self.fails[f] & (self.masks & before == 0)].sum(1)

    def orders(self) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """(order, removed at each step), an order once; the lists are altered in place."""
        order = list(range(self.k))
        removed = [self._removed(f, (1 << f) - 1) for f in order]
        yield order, removed
        for i in transpositions(self.k):
            before = sum(1 << f for f in order[:i])
            order[i], order[i + 1] = order[i + 1], order[i]
            removed[i] = self._removed(order[i], before)
            removed[i + 1] = self._removed(order[i + 1], before | 1 << order[i])
            yield order, removed

    def table(self, letters: str) -> dict[str, np.ndarray]:
        """Columns, order by order, step by step: each of (orders * steps, parts)."""
        shapley = np.zeros((self.k, len(self.total)), np.int64)
        names, steps, filters, kept, lost, redundant = [], [], [], [], [], []
        for order, removed in self.orders():
            left = self.total
            for s, f in enumerate(order):
                shapley[f] += removed[s][:, 0]
                left = left - removed[s][:, 0]
                names.append("".join(letters[x] for x in order))
                steps.append(s + 1)
                filters.append(f)
                kept.append(left)
                lost.append(removed[s])
                redundant.append(self.failing[f] - removed[s][:, 0])
        return {"order": np.array(names), "step": np.array(steps), "kept": np.array(kept), "lost": np.array(lost), "redundant": np.array(redundant), "unique": np.array([self.unique[f] for f in filters]), "shapley": shapley[filters]}


def walked(letters: str, losses: list[str]):
    """Rows (part, cells) → the rows of all orders of each part."""
    k, schema = len(letters), _schema(losses)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), PARTS):
                parts, lists = batch.column(0).slice(a, PARTS), batch.column(1).slice(a, PARTS)
                cells = np.zeros((len(parts), 1 << k, 1 + len(losses)), np.int64)
                flat = lists.flatten()
                at = np.repeat(np.arange(len(parts)), lists.value_lengths().to_numpy())
                mask = flat.field("mask").to_numpy()
                for c, name in enumerate(["docs", *losses]):
                    cells[at, mask, c] = flat.field(name).to_numpy()
                t, n = Walk(cells, k).table(letters), len(parts)
                rows = len(t["step"])
                columns = [
                    parts.take(pa.array(np.tile(np.arange(n), rows))),
                    pa.array(np.repeat(t["order"], n)),
                    pa.array(np.repeat(t["step"], n), pa.int32()),
                    *(pa.array(x.ravel()) for x in (t["kept"], t["lost"][:, :, 0], t["redundant"], t["unique"])),
                    *(pa.array(t["lost"][:, :, 1 + c].ravel()) for c in range(len(losses))),
                    pa.array(t["shapley"].ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return work


def _schema(losses: list[str]) -> pa.Schema:
    longs = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]
    return pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((n, pa.int64()) for n in longs)])


def audit(rows: DataFrame, part: Column, fails: dict[str, Column], losses: dict[str, Column]) -> DataFrame:
    """For each part, each order of the filters and each step one row: ``part``
    (string; null as empty), ``filter_order``, ``step`` (from 1), ``kept`` after
    it, ``removed`` here, ``redundant`` (fail its filter, removed before),
    ``unique_fails`` (fail no other filter), a column for each of ``losses``
    (rows removed here for which it is true), and ``shapley``: what its filter
    removes, summed over all orders.

    ``fails`` has a letter and a condition for each filter, eight at most; null
    counts as passed, as in ``losses``.  Equal rows count each.  A table without
    rows has no parts and gives none.
    """
    if not 0 < len(fails) <= MOST_FILTERS or any(len(x) != 1 for x in fails):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one letter")
    true = lambda c: F.coalesce(c.cast("boolean"), F.lit(False)).cast("int")
    mask = sum((true(c) * (1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    names = list(losses)
    each = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(true(c).alias(n) for n, c in losses.items()))
    cells = each.groupBy("part", "mask").agg(F.count("*").alias("docs"), *(F.sum(n).cast("long").alias(n) for n in names))
    # 2^k cells of a part at most
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", *names)).alias("cells"))
    ddl = ", ".join(f"`{f.name}` {'string' if pa.types.is_string(f.type) else 'int' if f.type == pa.int32() else 'bigint'}" for f in _schema(names))
    return lists.mapInArrow(walked("".join(fails), names), ddl)


#: Words, and characters of markup.
WORD, MARKS = r"[^\x20\x09-\x0D]+", "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions on a text: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of whole texts by four conditions on the text (A to D) and E:
    the text of a smaller id, wherever in the table, is the same.

    A null text is empty; a null id is neither smaller nor larger than another,
    so that its row passes E.  Rows that repeat an id count each, and none of
    them makes another fail E.  ``good_lost`` and ``toxic_lost`` take a document
    as labelled if any of its labels says so.  Further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    conditions = text_failures(F.col("text"))
    with Workspace(spark, "audit") as space:
        rows = space.staged(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in conditions.items())), "masks")
        firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        # texts that come once have no smaller id, and needn't meet
        repeated = space.staged(firsts.where("n > 1"), "repeated")
        told = spread_join(rows, repeated, ["digest"], ["id", "part"], how="left")
        marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        # rows without an id meet no label; they are spread by their text instead of gathering under null
        keyed = told.withColumns({"named": F.col("id").isNotNull(), "key": F.coalesce("id", F.xxhash64("digest", "part"))})
        marked = keyed.join(marks.select(F.lit(True).alias("named"), F.col("id").alias("key"), "good", "toxic"), ["named", "key"], "left")
        fails = {k: F.col(k) for k in conditions} | {"E": F.col("id") > F.col("first")}
        return staged(audit(marked, F.col("part"), fails, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}), "audit-result")
