"""The operators applied to the driver's tables, whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import config_packing, decontaminate, embedding, filter_audit, hard_negatives, html_extract, jaccard, oracles, packing, quality, secrets, sharding, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Fixed value: the name and id of the vocabulary's end of text.
SPECIALS = {"<|endoftext|>": 50256}
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC and read back."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the convolutional network."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of equal row counts."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sharded = sharding.feistel_shards(rows, "doc_id", 16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, judged by who carries them.

    A document's source is its owner; a source's documents in one language are
    a repository.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.owned_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"), keep_text=False)
    return secrets.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN, specials=SPECIALS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the counterfactually regularised model."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets of all documents, and which are linked."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the passages."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label within cosine 0.93 of each other."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in each of their orders."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed whole into as few sequences of 2048 tokens as can be."""
    return config_packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_html_extract,
        op3_quality,
        op4_feistel_shards,
        op5_secrets,
        op6_packing,
        op7_toxicity,
        op8_jaccard_join,
        op9_decontaminate,
        op10_embedding_join,
        op11_filter_audit,
        op12_config_packing,
        op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = oracles.ORACLES
