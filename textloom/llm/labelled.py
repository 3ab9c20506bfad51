"""Bounded samples of labelled documents, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, and bytes of their texts.
ROWS, BYTES = 4000, 12_000_000


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, left_out: int, rows: int = ROWS, most: int = BYTES) -> tuple[list[str], list[float]]:
    """Texts and labels (0 to 1) of at most ``rows`` documents outside the fold
    ``left_out``, in the order of a hash; a text that doesn't fit in what is left
    of ``most`` bytes is passed over, and neither class takes over three quarters.

    Null labels are skipped, a document with several labels gets their mean, a
    null text is empty, of several texts of one id the least counts.  Texts are
    given back whole, once each: equal ones among them teach nothing more.
    """
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    told = told.where(fold(F.col("doc_id"), of) != left_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(told), "doc_id")  # ``rows`` bounds it
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select(F.xxhash64("doc_id").alias("h"), "text", "y")
    # the texts that fit are settled on their sizes first, so that no more is collected; a row for each id
    left, share = most, {True: 3 * most // 4, False: 3 * most // 4}
    chosen = []
    for h, b, toxic in sorted(tuple(r) for r in one.select("h", F.octet_length("text"), F.col("y") > 0.5).collect()):
        if b <= min(left, share[toxic]):
            left, share[toxic] = left - b, share[toxic] - b
            chosen.append(h)
    if not chosen:
        return [], []
    seen: dict[str, float] = {}
    for r in sorted(one.where(F.col("h").isin(chosen)).select("h", "text", "y").collect()):
        seen.setdefault(r["text"], r["y"])
    return list(seen), list(seen.values())
