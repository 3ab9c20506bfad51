"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into chunks of sixteen bytes, each
overlapping the next by half, from the first byte to the last.  Learned filters
run over the chunks; a chunk also knows how well it repeats the bytes just
before it, at its best period.  Each filter's largest answer in the text goes
into one logistic unit.

Scoring is a map over Arrow batches; a text of any length is read whole, in
pieces of bounded size whose maxima are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.labelled import ROWS, fold, sample
from textloom.llm.util import slices, small_batches

HALF, WIDTH, FILTERS = 8, 4, 24
#: Periods, in bytes, at which a chunk may repeat what is before it; halves between two texts.
PERIODS = range(2, 41)
APART = 5
#: Bytes of a text that are read at once, a multiple of a half.
PIECE = 1 << 20
EPOCHS, BATCH, RATE, DECAY = 20, 32, 0.015, 1e-4
#: Bytes of text that the network is fitted on.
FIT_BYTES = 10_000_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def chunks(data: np.ndarray, offsets: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(half chunks of bytes, repetition of each chunk, first and last + 1 chunk of each text).

    Texts are padded with zero bytes to whole halves and one more, so that
    chunk ``i`` is the halves ``i`` and ``i + 1`` and none spans two texts, and
    stand so far apart that no text repeats another.  The first ``before`` bytes
    (whole halves) of each are only what the rest may repeat.
    """
    sizes = np.diff(offsets)
    halves = -(-sizes // HALF) + 1
    firsts = np.concatenate([[0], np.cumsum(halves + APART)]) + APART
    flat = np.zeros(int(firsts[-1]) * HALF, np.uint8)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (firsts[:-1] * HALF).tolist()):
        flat[at : at + b - a] = data[a:b]
    # padding must look like nothing, itself included
    plain = flat.astype(np.uint16)
    empty = flat == 0
    plain[empty] = (256 + np.arange(len(flat)) % 64).astype(np.uint16)[empty]
    same, sums = np.zeros(len(flat), np.uint8), np.zeros(len(flat) // HALF, np.uint64)
    best = np.zeros_like(sums)
    for lag in PERIODS:
        np.equal(plain[lag:], plain[:-lag], out=same[lag:].view(bool))
        # a product's highest byte is the sum of the eight flags of a half
        np.multiply(same.view(np.uint64), np.uint64(0x0101010101010101), out=sums)
        np.maximum(best, sums, out=best)
    best >>= np.uint64(56)
    best[:-1] += best[1:]
    return flat.reshape(-1, HALF), (best / (2.0 * HALF)).astype(np.float32), firsts[:-1] + before // HALF, firsts[:-1] + halves


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.5, (256, WIDTH)).astype(np.float32)
        self.e[0] = 0
        self.w = r.normal(0, 1 / np.sqrt(2 * HALF * WIDTH), (2 * HALF * WIDTH, FILTERS)).astype(np.float32)
        self.r = r.normal(0, 0.5, FILTERS).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w, self.r, self.b, self.v, self.c]

    def answers(self, halves: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Filter answers of chunks 0 .. n-2 of n halves, before the rectifier."""
        x = np.take(self.e, halves.ravel(), axis=0).reshape(len(halves), HALF * WIDTH)
        k = HALF * WIDTH
        z = x[:-1] @ self.w[:k]
        z += x[1:] @ self.w[k:]
        z += repeats[: len(z), None] * self.r
        return z

    def largest(self, data: np.ndarray, offsets: np.ndarray, before: int = 0, after: int = 0) -> np.ndarray:
        """Largest answer of each filter in each text; ``after`` chunks at its end belong to the next piece."""
        halves, repeats, first, last = chunks(data, offsets, before)
        z = self.answers(halves, repeats)
        bounds = np.stack([first, np.minimum(last - after, len(z))], axis=1).ravel()
        return np.maximum.reduceat(np.vstack([z, np.full((1, FILTERS), -np.inf, np.float32)]), bounds)[::2]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest rectified answer of each filter in each text; a long text is read in pieces."""
        if len(offsets) > 2 or len(data) <= PIECE:
            return np.maximum(self.largest(data, offsets) + self.b, 0)
        top = np.full((1, FILTERS), -np.inf, np.float32)
        for a in range(0, len(data), PIECE):
            # with what the piece may repeat before it, and the half that its last chunk reaches into
            low, high = max(0, a - APART * HALF), min(len(data), a + PIECE + HALF)
            if a == 0 or high - a > HALF:
                top = np.maximum(top, self.largest(data[low:high], np.array([0, high - low]), a - low, 2 if high < len(data) else 0))
        return np.maximum(top + self.b, 0)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.pooled(data, offsets) @ self.v + self.c).astype(np.float64)))


def train(texts: list[str], labels: list[float], seed: int = 7) -> Network:
    """Adam on the log loss; both classes weigh the same.  Without texts, or of one class, the scores are its share."""
    net, y = Network(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.v[:] = 0
        net.c[:] = 0 if not len(y) else (4 if y[0] > 0.5 else -4)
        return net
    coded = [t.encode() for t in texts]
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-6), 0.5 / max((y <= 0.5).mean(), 1e-6)).astype(np.float32)
    r = np.random.default_rng(seed)
    m, s, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
            data = np.frombuffer(b"".join(coded[i] for i in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(coded[i]) for i in rows])])
            halves, repeats, first, last = chunks(data, offsets)
            z = net.answers(halves, repeats)
            at = np.stack([a + z[a:b].argmax(0) for a, b in zip(first, np.minimum(last, len(z)))])
            top = z[at, np.arange(FILTERS)] + net.b
            pool = np.maximum(top, 0)
            d = (1 / (1 + np.exp(-(pool @ net.v + net.c))) - y[rows]) * weight[rows] / len(rows)
            dp = d[:, None] * net.v * (top > 0)
            two = np.concatenate([halves[at], halves[at + 1]], axis=2)  # text, filter, byte
            x = np.take(net.e, two.ravel(), axis=0).reshape(len(rows), FILTERS, -1)
            dw = np.einsum("df,dfk->kf", dp, x)
            dx = (dp[:, :, None] * net.w.T[None]).reshape(-1, WIDTH)
            de = np.stack([np.bincount(two.reshape(-1), weights=dx[:, k], minlength=256) for k in range(WIDTH)], axis=1)
            de[0] = 0
            grads = [de, dw, (dp * repeats[at]).sum(0), dp.sum(0), pool.T @ d, d.sum(keepdims=True)]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for p, g, mm, ss in zip(net.parts(), grads, m, s):
                g = g.astype(np.float32) + DECAY * p
                mm += 0.1 * (g - mm)
                ss += 0.001 * (g * g - ss)
                p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.999**t)) + 1e-8)
    return net


def score_texts(df: DataFrame, model, text_col: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the model's score of every text (null counts as empty); a column of that name is replaced.

    ``model`` has ``scores(bytes, offsets)`` and is broadcast; its size is fixed.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(column)
    names, at = df.columns, df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, _, data, offsets in slices(batch.column(at), 300_000)]
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, column])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{column}` double"])
    return df.mapInArrow(work, ddl)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = FIT_BYTES) -> Network:
    """The network of a bounded sample of the documents that ``labels.quality`` marks outside the held-out fold."""
    return train(*sample(docs, labels, "quality", FOLDS, HELD_OUT, rows, most))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null text is scored as an empty one, texts of any length in pieces of
    bounded size; equal rows each give a row with the same score, a null id
    falls in the fold of an empty text, further columns are ignored.  Without
    labels, or with labels of one kind, all scores are equal.
    """
    scored = score_only(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_only(docs: DataFrame, model) -> DataFrame:
    """doc_id and score; texts stay in the workers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), 300_000):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(shared.value.scores(data, offsets), pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(work, "doc_id bigint, score double")
