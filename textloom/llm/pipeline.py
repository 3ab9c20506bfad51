"""Stages of the corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and reads the whole table that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard, packing, quality, secrets
from textloom.llm.queries import PATTERN, RANKS, SPECIALS, table
from textloom.llm.util import discard, scope, scratch, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold: null texts count as empty ones, equal rows fare alike,
    ids play no part.

    The network is fitted on the labelled documents of the raw table, which
    are the ones that labels are about.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_texts(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Documents with a number of their own for each row, staged so that it stays; ids may be null or repeated."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies, a null id counting as the largest.

    Rows are linked and kept one by one, so that rows with one id but unlike
    texts all stay.  Of rows without words, one of those equal in all columns stays.
    """
    rows = numbered(docs, "rows-near")
    links = staged(jaccard.link_documents(rows, "row"), "links-near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    kept = links.where("n_shingles > 0").join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("m")).select("m.row")
    bare = rows.join(links.where("n_shingles = 0").select("row"), "row", "left_semi")
    bare = bare.groupBy(F.sha2("text", 256).alias("h"), *(c for c in COLUMNS if c != "text")).agg(F.min("row").alias("row")).select("row")
    return rows.join(kept.unionAll(bare), "row", "left_semi").select(*COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, told row by row: another row of the same id, or of none, stays."""
    rows = numbered(docs, "rows-leaks")
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), "row").select("row").distinct()
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, equal rows and null texts too; values of secrets are replaced, except copied examples.

    ``n_chars`` follows the text where it changes.
    """
    found = secrets.redact(secrets.owned_secrets(docs.select(*COLUMNS), F.col("source"), F.concat_ws("/", "source", "lang")))
    changed = F.exists("secrets", lambda s: s["class"] != "example")
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null text is empty, equal rows are packed each."""
    return packing.pack_documents(docs, RANKS, PATTERN, specials=SPECIALS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontaminate", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage needed is deleted once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
