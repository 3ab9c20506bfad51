"""What models plug into, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]: ...


class Generator(Protocol):
    def stream(self, messages: list[dict]) -> Iterator[str]: ...


class HashEmbedder:
    """Signed feature hashing of words, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


class OverlapReranker:
    """Share of the query's words that a document has."""

    def rerank(self, query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]:
        asked = set(re.findall(r"\w+", query.lower()))
        scores = [(i, len(asked & set(re.findall(r"\w+", d.lower()))) / max(1, len(asked))) for i, d in enumerate(documents)]
        return sorted(scores, key=lambda x: (-x[1], x[0]))[:top_n]


class EchoGenerator:
    """Says the last message again, word by word."""

    def stream(self, messages: list[dict]) -> Iterator[str]:
        for word in messages[-1]["content"].split():
            yield word + " "


BATCH = 64


def embed(df: DataFrame, text: str, column: str, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """``df`` with a vector for each text, in batches; a batch that fails is tried text by text, and a text that fails stops the job.

    As many batches run at once as there are tasks.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    out += embedder.embed(some)
                except Exception:
                    if len(some) == 1:
                        raise
                    for t in some:
                        out += embedder.embed([t])
            yield pd.Series(out)

    return df.withColumn(column, run(F.col(text)))
