"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a set of lengths that fit in one sequence.  The program asks
for the least (fractional) number of configurations that cover each length as
often as it occurs.  It has a row for each length and knows nothing of
documents, so that it is as large for a thousand of them as for a trillion.
Multiplicative weights solve it: a length's weight falls exponentially with the
share of it that is covered, and a knapsack over the weights, by dynamic
programming, prices configurations; one table gives the best configuration
that holds any given length.  Counts are rounded by running sums; what rounding
and the last rounds leave over fills sequences from the longest piece on, with
one or two pieces that close the gap where there are such.

Which piece goes where follows from the plan alone: pieces of a length are
numbered across the corpus, and each configuration takes a run of numbers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.packing import WordMemory
from textloom.llm.util import Workspace, slices, small_batches, staged

END_ID = 0
CAPACITY = 2048
#: Words of letters that are encoded in one text, and bytes of text whose words are looked up at once.
TOGETHER, SLICE_BYTES = 64, 1_000_000
#: Bytes that part words, as ``bytes.split`` parts them.
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Rounds of weights; a configuration for each length in each round is the most that a plan has.
ROUNDS = 40
#: How fast weights fall, how much worse than the best a configuration may be, and the share of a length that a round may
#: cover.  Slow ones do where lengths mix freely; the others are for histograms that force weights apart.
PACES = ((0.005, 0.0005, 0.25), (0.3, 0.01, 0.1), (1.5, 0.03, 0.1))
#: A plan so near its bound is not tried to be bettered.
GOOD = 1.001

# --------------------------------------------------------------------------
# Ids
# --------------------------------------------------------------------------


class WordIds(WordMemory):
    """Ids of whole texts by a tokenizer that parts at white space and drops it.

    Nothing such a tokenizer does reaches across white space, so that a text's
    ids are those of its words in a row.  Words are remembered by their bytes.
    """

    most = 1 << 20  # this tokenizer takes several times as long for a word as a byte-level one
    #: Signs that a run of letters may stand between: it is a piece of its own there.
    SIGNS = b".,;:!?()\"-#$%&*+/=@[]^_`{}~|"

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel as they are
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        #: Ids that end a piece, where the tokenizer marks them; each piece has one, at its end.
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        super().__init__()

    @staticmethod
    def _latin(word: bytes) -> bool:
        letters = word.decode()
        return letters.isalpha() and max(letters) < "\u0250"

    def _encoded(self, words: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._put(words, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _encoded_together(self, words: list[bytes]) -> None:
        """Words of letters alone, which are mostly one piece each: many in one text, parted by the ids that end pieces."""
        texts = [b" ".join(words[a : a + TOGETHER]).decode() for a in range(0, len(words), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.last[ids])
        # a word has a piece at least: as many pieces as words are one for each
        if len(ends) == len(words) and ends[-1] == len(ids) - 1:
            self._put(words, np.diff(ends, prepend=-1), ids)
        else:
            self._encoded(words)

    def _learn(self, words: set[bytes]) -> None:
        """Words of letters with signs around them are put together from their parts, and letters count as small ones."""
        parts: dict[bytes, list[bytes]] = {}
        wholes: set[bytes] = set()
        for w in words:
            core = w.strip(self.SIGNS)
            if core.isalpha() and core.isascii() or core is not w and self._latin(core):
                small = core.lower() if core.isascii() else core
                if small == w:
                    wholes.add(w)
                elif core is w or len(core) == len(w):
                    parts[w] = [small]
                else:
                    a = w.index(core)
                    parts[w] = [p for p in (w[:a], small, w[a + len(core) :]) if p]
            else:
                wholes.add(w)
        for p in parts.values():
            wholes.update(p)
        some = [w for w in wholes if w not in self.index]
        letters = [w.isalpha() if w.isascii() else self._latin(w) for w in some] if self.last.any() else [False] * len(some)
        for encoded, kind in ((self._encoded_together, True), (self._encoded, False)):
            of = [w for w, x in zip(some, letters) if x == kind]
            for a in range(0, len(of), 4096):
                encoded(of[a : a + 4096])
        if parts:
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts.values())), np.int64)
            ids, upto = self._ids(at)
            edges = upto[np.cumsum([0, *map(len, parts.values())])]
            self._put(list(parts), np.diff(edges), ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, edges) of texts given as bytes and offsets."""
        used = ~WHITE[data]
        before, after = np.append(False, used[:-1]), np.append(used[1:], False)
        before[offsets[:-1][offsets[:-1] < len(data)]] = False  # words end with their text
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        begin, end = np.flatnonzero(used & ~before), np.flatnonzero(used & ~after) + 1
        ends = np.append(0, np.cumsum(end - begin)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[used])]).dictionary_encode()
        _, ends, raw = words.dictionary.buffers()
        raw, ends = raw.to_pybytes() if raw else b"", np.frombuffer(ends, np.int32, len(words.dictionary) + 1).tolist()
        at = self._at([raw[a:b] for a, b in zip(ends, ends[1:])])
        ids, upto = self._ids(at[words.indices.to_numpy()])
        return ids, upto[np.searchsorted(begin, offsets)]


_WORDS: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    if file not in _WORDS:
        _WORDS[file] = WordIds(file)
    return _WORDS[file]


# --------------------------------------------------------------------------
# Plan
# --------------------------------------------------------------------------


def priced(worth: np.ndarray) -> np.ndarray:
    """The most worth in each room 0 .. capacity, by an unbounded knapsack.

    ``worth`` is of length capacity + 1, -inf for lengths that there are not.
    """
    room = len(worth)
    best = np.zeros(room)
    for c in range(1, room):
        best[c] = max(best[c - 1], (worth[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def taken(worth: np.ndarray, best: np.ndarray, room: int, least: float, covered: np.ndarray) -> dict[int, int]:
    """Lengths, with how often, that fill a room with a worth of ``least`` or more: of all that still allow it, the least covered."""
    found: dict[int, int] = {}
    while room > 0 and least > 0:
        can = np.flatnonzero(worth[1 : room + 1] + best[room - 1 :: -1] >= least) + 1
        if not len(can):
            break
        k = int(can[covered[can].argmin()])
        found[k] = found.get(k, 0) + 1
        room, least = room - k, least - worth[k]
    return found


@dataclass
class Plan:
    """Configurations with how often each is used, in the order of their sequences; ``bound`` is the least that any packing takes."""

    capacity: int
    uses: list[tuple[dict[int, int], int]] = field(default_factory=list)
    bound: int = 0
    by_program: int = 0

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.uses)

    def runs(self) -> np.ndarray:
        """A column for each run of pieces of a length: key, first number, copies in a sequence, first sequence, first offset; sorted by key.

        The key is the length and the number, 50 bits for the number.
        """
        number = np.zeros(self.capacity + 1, np.int64)
        out, sequence = [], 0
        for config, times in self.uses:
            offset = 0
            for length, copies in sorted(config.items(), reverse=True):
                out.append(((length << 50) + int(number[length]), int(number[length]), copies, sequence, offset))
                number[length] += copies * times
                offset += copies * length
            sequence += times
        return np.array(sorted(out), np.int64).reshape(-1, 5).T


def solved(demand: np.ndarray, rate: float, near: float, share: float, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[tuple[int, int], ...], float]], float]:
    """Configurations with their fractional counts, and a lower bound of the program, by multiplicative weights.

    ``demand`` says how often each length 0 .. capacity occurs.
    """
    capacity = len(demand) - 1
    here = np.flatnonzero(demand)
    here = here[here > 0]
    covered = np.zeros(capacity + 1)
    counts: dict[tuple[tuple[int, int], ...], float] = {}
    bound = 0.0
    for _ in range(rounds):
        open_ = here[covered[here] < 1]
        if not len(open_):
            break
        worth = np.full(capacity + 1, -np.inf)
        worth[here] = here / capacity * np.exp(-rate * covered[here])
        # weights over the most that a configuration is worth are a solution of the dual program
        bound = max(bound, float((worth[here] * demand[here]).sum()) / priced(worth)[-1])
        worth[here[covered[here] >= 1]] = -np.inf
        best = priced(worth)
        limit = np.minimum(covered + share, 1.0)
        for length in open_[::-1].tolist():
            least = (1 - near) * best[capacity] - worth[length]
            if covered[length] >= limit[length] or best[capacity - length] < least:
                continue
            config = taken(worth, best, capacity - length, least, covered - limit)
            config[length] = config.get(length, 0) + 1
            step = min((limit[k] - covered[k]) * demand[k] / n for k, n in config.items())
            if step <= 0:
                continue
            name = tuple(sorted(config.items()))
            counts[name] = counts.get(name, 0.0) + step
            for k, n in config.items():
                covered[k] += step * n / demand[k]
                if limit[k] - covered[k] < 1e-9:
                    covered[k] = limit[k]
    return list(counts.items()), bound


def filled(left: np.ndarray, capacity: int) -> dict[int, int]:
    """A sequence for what is left: the longest piece, then one or two that close the gap, else the longest that fits."""
    left = left.copy()
    config: dict[int, int] = {}

    def take(k: int) -> None:
        config[k] = config.get(k, 0) + 1
        left[k] -= 1

    gap = capacity
    longest = np.flatnonzero(left)[-1]
    while longest:
        take(int(longest))
        gap -= int(longest)
        if gap and left[gap]:
            take(gap)
            break
        half = gap // 2
        pairs = np.flatnonzero((left[1 : half + 1] > 0) & (left[gap - 1 : gap - half - 1 : -1] > 0)) + 1 if gap > 1 else []
        pairs = [k for k in pairs[:2] if 2 * k < gap or left[k] > 1]
        if len(pairs):
            take(int(pairs[0]))
            take(gap - int(pairs[0]))
            break
        fits = np.flatnonzero(left[: gap + 1])
        longest = fits[-1] if len(fits) else 0
    return config


def rounded(demand: np.ndarray, counts: list[tuple[tuple[tuple[int, int], ...], float]]) -> Plan:
    """Whole numbers of configurations by running sums, and sequences for what they leave."""
    capacity, left, running = len(demand) - 1, demand.copy(), 0.0
    plan = Plan(capacity)
    for config, x in counts:
        times = int(running + x) - int(running)
        running += x
        times = min(times, min(int(left[k]) // n for k, n in config))
        if times > 0:
            plan.uses.append((dict(config), times))
            for k, n in config:
                left[k] -= n * times
    plan.by_program = plan.sequences
    while left.any():
        config = filled(left, capacity)
        times = min(int(left[k]) // n for k, n in config.items())
        plan.uses.append((config, times))
        for k, n in config.items():
            left[k] -= n * times
    return plan


def planned(demand: np.ndarray) -> Plan:
    """Sequences for ``demand[k]`` pieces of each length k, 1 to capacity: the best of the plans tried."""
    demand = np.asarray(demand, np.int64).copy()
    capacity = len(demand) - 1
    full, demand[capacity] = int(demand[capacity]), 0
    bound = -(-int((demand * np.arange(capacity + 1)).sum()) // capacity)
    plan = Plan(capacity)
    if demand.any():
        plans = []
        for pace in PACES:
            counts, least = solved(demand, *pace)
            bound = max(bound, int(np.ceil(least * (1 - 1e-9))))
            plans.append(rounded(demand, counts))
            plan = min(plans, key=lambda p: p.sequences)
            if plan.sequences <= max(bound + 1, GOOD * bound):
                break
    # pieces that are full sequences come first
    plan.uses = ([({capacity: 1}, full)] if full else []) + plan.uses
    plan.by_program, plan.bound = plan.by_program + full, bound + full
    return plan


# --------------------------------------------------------------------------
# Documents
# --------------------------------------------------------------------------

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, cell int, number bigint"


def cut_documents(file: str, capacity: int, with_ids: bool):
    """Rows (id, text) → pieces; each task numbers its pieces of each length."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        cell = task.partitionId() if task else 0
        seen = [0] * (capacity + 1)
        encoder = word_ids(file)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, data, offsets in slices(batch.column(1), SLICE_BYTES):
                all_ids, edges = encoder.encode(data, offsets)
                rows, held = [], []
                for name, a, b in zip(docs[i:j], edges[:-1].tolist(), edges[1:].tolist()):
                    ids = np.append(all_ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((name, piece, start, len(part), zlib.crc32(part.tobytes()), cell, seen[len(part)]))
                        seen[len(part)] += 1
                        if with_ids:
                            held.append(part.astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if with_ids else []), names=names + (["ids"] if with_ids else []))

    return work


def placed(plan, columns: list[str]):
    """Rows of pieces with their number across the corpus → the same with sequence and offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, copies, sequence, offset = plan.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, (length << 50) + number, "right") - 1
            k = number - first[at]
            extra = [pa.array(sequence[at] + k // copies[at]), pa.array(offset[at] + k % copies[at] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + extra, names=[*columns, "sequence_id", "offset"])

    return work


def pack_documents(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids by the tokenizer of ``file`` (which must part at
    white space and drop it) and one end id; only longer ones than ``capacity``
    are cut, at its multiples.  ``start`` counts its document's ids before the
    piece, ``offset`` those before it in the sequence; ``ids_crc32`` covers the
    ids as little-endian unsigned 32-bit numbers.  Null and empty texts are
    their end id alone.  Equal rows are packed each on its own, a null id stays
    null, further columns are ignored, and an empty table gives an empty table.
    """
    spark = df.sparkSession
    small_batches(spark)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    with Workspace(spark, "config-packing") as space:
        texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
        pieces = space.staged(texts.mapInArrow(cut_documents(file, capacity, with_ids), PIECE + (", ids array<int>" if with_ids else "")), "pieces")
        counts = pieces.groupBy("cell", "length").agg(F.count("*").alias("n"))
        demand = np.zeros(capacity + 1, np.int64)
        for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length
            demand[length] = n
        plan = spark.sparkContext.broadcast(planned(demand).runs())  # ROUNDS and the capacity bound it
        # a row for each task of the cutting: those of a length follow one another
        before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("cell", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        numbered = pieces.join(offsets, ["cell", "length"]).withColumn("number", F.col("number") + F.col("before"))
        types = dict(pieces.dtypes)
        ddl = ", ".join([f"{c} {types[c]}" for c in columns] + ["sequence_id bigint", "offset bigint"])
        return staged(numbered.select(*columns, "number").mapInArrow(placed(plan, columns), ddl).withColumnRenamed("doc_id", id_col), "config-packing-result")
