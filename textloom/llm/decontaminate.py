"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words; words at its free places are
ignored, so that a substituted word there leaves the hash as it is.  Seeds of
the benchmark's items and of the documents are joined on their hashes, and
each hit is verified along its diagonal: word by word, where substitutions cost
more than matches bring, the best stretch must be long enough.

Letters count without case.  Documents go through a Bloom filter of the items' hashes first.  Its size is
bounded; beyond the bound it only lets more through to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.util import Workspace, mix, slices, small_batches, spread_join, staged, word_hashes

#: Places of a run of words that count (1) or are free (0).  Every
#: stretch that is accepted below has a hit of one of them, whatever its
#: substitutions; items with few words have their own, by their number of words.
MASKS = ("11100100101", "1101001000101", "1110010101", "1111011")
SHORT = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111",),
    6: ("11111",),
    7: ("111111", "1110111"),
    8: ("1110111",),
    9: ("1110111",),
    10: ("1110111", "11101101"),
    11: ("1110111", "111010011"),
    12: ("1111011", "1110100011"),
    13: ("1111101", "11101000011"),
}
#: Words that must match in a stretch, or four fifths of an item with few words.
LEAST_WORDS = 13
MISMATCH = 2
FILTER_BITS = (1 << 20, 1 << 27)
PROBES = 3


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words."""
    return SHORT.get(n, MASKS) if n else ()


def seed_hashes(h: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) for each place where the mask lies within one text."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = mix(np.arange(1, len(mask) + 1, dtype=np.uint64) + np.uint64(len(mask) << 8)) | np.uint64(1)
    s = np.zeros(m, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            s += h[k : k + m] * factors[k]
    at = np.flatnonzero(doc[:m] == doc[len(mask) - 1 :])
    return mix(s[at] + np.uint64(len(mask) * 2 + mask.count("1"))), at


class Bloom:
    def __init__(self, hashes: np.ndarray, bits: int):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8)
        for p in self.places(hashes):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield ((h >> np.uint64(17 * k)) & np.uint64(self.bits - 1)).astype(np.int64)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Indices of hashes that may be in the set."""
        at = np.arange(len(h))
        for k in range(PROBES):
            p = ((h[at] >> np.uint64(17 * k)) & np.uint64(self.bits - 1)).astype(np.int64)
            at = at[(self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        return at


def seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, words (hashes), seeds (hash, place) of each item."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            h, doc, _, _ = word_hashes(data, offsets)
            rows = []
            for k in range(j - i):
                own = h[doc == k]
                found = [seed_hashes(own, np.zeros(len(own), np.int64), m) for m in masks_of(len(own))]
                s = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
                at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                rows.append((own.tobytes(), len(own), s.view(np.int64), at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                names=["item", "item_words", "n", "seeds", "places"],
            )


ITEMS = "item bigint, item_words binary, n int, seeds array<bigint>, places array<int>"


def suspects(bloom, lengths: list[int]):
    """Documents with a hash that passes the filter: id, word hashes, hits."""
    masks = sorted({*MASKS, *(m for n in lengths for m in SHORT[n])})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                h, doc, _, _ = word_hashes(data, offsets)
                hits = []
                for m in masks:
                    s, at = seed_hashes(h, doc, m)
                    k = known.maybe(s)
                    hits.append((s[k], at[k]))
                s, at = np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits])
                if not len(at):
                    continue
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                which, first = np.unique(doc[at], return_index=True)
                ends = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j].take(pa.array(which)),
                        pa.array([h[edges[d] : edges[d + 1]].tobytes() for d in which], pa.binary()),
                        pa.array([s[a:b].view(np.int64) for a, b in zip(first, ends)], pa.list_(pa.int64())),
                        pa.array([(at[a:b] - edges[d]).astype(np.int32) for a, b, d in zip(first, ends, which)], pa.list_(pa.int32())),
                    ],
                    names=["doc", "words", "seeds", "places"],
                )

    return work


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch with the most matches less MISMATCH times its mismatches."""
    score = np.where(match, 1, -MISMATCH)
    sums = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return int(match[start:end].sum()), start, end


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a document that each of its lines (item, shift, n) lays an item over: (row, doc, item, shift, from, words)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, doc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            words = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
            lines = batch.column(3)[i].values
            item, shift, n = (lines.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            low, high = np.maximum(shift, 0), np.minimum(shift + n, len(words))
            for a in range(0, len(item), 10_000):
                part = slice(a, a + 10_000)
                cut = [words[x:y].tobytes() for x, y in zip(low[part].tolist(), high[part].tolist())]
                k = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([row] * k, pa.int64()), pa.array([doc] * k, pa.int64()), pa.array(item[part]), pa.array(shift[part]), pa.array(low[part]), pa.array(cut, pa.binary())], names=["row", "doc", "item", "shift", "low", "words"])


STRETCHES = "row bigint, doc bigint, item bigint, shift bigint, low bigint, words binary"


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified rows of (row, doc, item, shift, low, words, item_words)."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            d, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (5, 6))
            shift, low = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
            if not len(d):
                continue
            n, start, end = best_stretch(d == b[low - shift : low - shift + len(d)])
            if n >= min(LEAST_WORDS, -(-4 * len(b) // 5)):
                out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), n, len(b), start + low, end + low))
        c = list(zip(*out)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["row", "doc", "item", "matched", "item_words", "start", "end"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: id, item, matched and
    item_words, first and last word (end exclusive) of the best stretch.

    Documents without a verified overlap have no row.  Null and empty texts
    and items match nothing, equal documents each give rows, a null id is
    given back, further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Workspace(spark, "decontaminate") as space:
        bench = space.staged(items.select(items[item_col].cast("long").alias("item"), F.lower(items[item_text].cast("string")).alias("t")).mapInArrow(seeds_of_items, ITEMS).where("n > 0"), "items")
        flat = bench.select("item", "n", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", F.col("n").alias("words_n"), F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_at"))
        n = flat.count()
        bits = max(FILTER_BITS[0], min(FILTER_BITS[1], 1 << (16 * max(1, n)).bit_length()))
        bloom = spark.sparkContext.broadcast(_filter(flat, bits))
        lengths = [r["n"] for r in bench.where(F.col("n") <= max(SHORT)).select("n").distinct().orderBy("n").collect()]

        found = docs.select(docs[id_col].cast("long").alias("doc"), F.lower(docs[text_col].cast("string")).alias("t")).mapInArrow(suspects(bloom, lengths), "doc bigint, words binary, seeds array<bigint>, places array<int>")
        rows = space.staged(found.withColumn("row", F.monotonically_increasing_id()), "suspects")
        hits = rows.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
        # a seed that very many documents or items have is dealt to salts, as is such an item; a document is read once
        lines = spread_join(hits, flat, ["seed"], ["row", "at"], hits.groupBy("seed").agg(F.count("*").alias("n")))
        lines = space.staged(lines.select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"), "words_n").distinct(), "lines")
        per_row = lines.groupBy("row").agg(F.collect_list(F.struct("item", "shift", "words_n")).alias("lines"))
        cut = rows.select("row", "doc", "words").join(per_row, "row").select("row", "doc", "words", "lines").mapInArrow(stretches, STRETCHES)
        # between the two Python steps, or each task would keep two workers, and executors never give them back meanwhile
        cut = cut.repartition("row", "item", "shift")
        both = spread_join(cut, bench.select("item", "item_words"), ["item"], ["row", "shift"], lines.groupBy("item").agg(F.count("*").alias("n")))
        told = both.select("row", "doc", "item", "shift", "low", "words", "item_words").mapInArrow(overlaps, "row bigint, doc bigint, item bigint, matched bigint, item_words bigint, start bigint, end bigint")
        best = told.groupBy("row", "item").agg(F.max_by(F.struct("doc", "matched", "item_words", "start", "end"), F.struct("matched", (-F.col("start")).alias("s"))).alias("b"))
        result = staged(best.select(F.col("b.doc").alias(id_col), F.col("item").alias(item_col), "b.matched", "b.item_words", "b.start", "b.end"), "overlaps")
    return result


def _filter(flat: DataFrame, bits: int) -> Bloom:
    """The filter of all seeds: each of its 64-bit words is put together by a grouping; the driver gets at most
    FILTER_BITS in all."""
    place = [F.shiftrightunsigned("seed", 17 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]
    each = flat.select("seed").distinct().select(F.explode(F.array(*place)).alias("p"))
    words = each.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    whole = Bloom(np.zeros(0, np.uint64), bits)
    told = words.toArrow()
    whole.data.view(np.uint64)[told.column(0).to_numpy()] = told.column(1).to_numpy().view(np.uint64)
    return whole
