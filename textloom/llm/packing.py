"""Harmonic packing of documents into token sequences.

A document is its token ids and one end id.  Stretches of a full sequence
stand alone; what is left over is put into a class by the reciprocal of its
share of the capacity: class ``k`` holds pieces of at most ``capacity // k``
tokens and closes a bin at exactly ``k`` pieces.  A piece that would fill less
than ``fill`` of its slot gives a slot-sized piece to the next class first, so
that padding stays small although every class is filled on its own.  Pieces
smaller than the last class's slots are put into one bin after another.

Each task packs the documents it reads, with one open bin for each class: no
shuffle, no state that grows, and the same rows again if a task is repeated.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.util import slices

END_ID = 0
CAPACITY = 1024
CLASSES = 16
FILL = 0.96
#: Words whose ids a worker remembers, and ids kept before it starts afresh.
CACHE_WORDS, CACHE_IDS = 1 << 18, 1 << 23
AS_IS = np.arange(256, dtype=np.uint8)
#: Bytes that are white space or control, and bytes that may begin or end wider white space.
CONTROL = (AS_IS < 32) | (AS_IS == 127)
WIDE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
FIRST, LAST = (np.isin(AS_IS, [w[k] for w in WIDE]) for k in (0, -1))


def beside_white(data: np.ndarray) -> np.ndarray:
    """Places of blanks next to white space of another kind or a control byte."""
    at = np.flatnonzero(data == 32)
    padded = np.concatenate([np.full(3, 65, np.uint8), data, np.full(3, 65, np.uint8)])
    before, after = padded[at + 2], padded[at + 4]
    found = CONTROL[before] | CONTROL[after]
    for k in np.flatnonzero(~found & (FIRST[after] | LAST[before])):
        i = int(at[k]) + 3
        found[k] = padded[i - 3 : i].tobytes().endswith(tuple(WIDE)) or padded[i + 1 : i + 4].tobytes().startswith(tuple(WIDE))
    return at[found]


class WordMemory:
    """Ids of words met before, by the words' bytes; what is missing is learned by the batch."""

    most = CACHE_WORDS

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.edges, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def _put(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) >= len(self.edges):
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.edges[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + len(words))))

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, edges) of known words."""
        begin, size = self.edges[at], self.edges[at + 1] - self.edges[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)], upto

    def _learn(self, words: set[bytes]) -> None:
        raise NotImplementedError

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, edges) of words, known or not."""
        return self._ids(self._at(words))

    def _at(self, words: list[bytes]) -> np.ndarray:
        """Places of words in the memory; those that aren't there are learned."""
        if len(self.index) > self.most or self.used > CACHE_IDS:
            self._clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missed = [words[k] for k in new]
            self._learn(set(missed))
            at[new] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        return at


class WordEncoder(WordMemory):
    """Ids of whole texts by a byte-level BPE, through a bounded memory of words.

    A blank between other characters than white space always begins a new piece
    of the pattern, and nothing merges across pieces, so that a text whose blanks
    all stand so is the sequence of its words, each with the blank before it.
    Texts with a blank next to other white space (of any kind) or a control
    byte, at the end, or with a special token's name, which stands for its id,
    are encoded in one piece.
    """

    #: Before the first word of a text, which has no blank before it; no other word begins so.
    FIRST = b"\n"

    def __init__(self, ranks_file: str, pattern: str, specials: dict[str, int]):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        self.names = [name.encode() for name in specials]
        self.blank = np.zeros(max([*ranks.values(), *specials.values()]) + 1, bool)
        self.blank[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        super().__init__()

    def _learn(self, words: set[bytes]) -> None:
        heads = [w for w in words if w.startswith(self.FIRST)]
        inner = [w for w in words if not w.startswith(self.FIRST)]
        if inner:
            ids = np.array(self.bpe.encode_ordinary((b" " + b" ".join(inner)).decode()), np.uint32)
            first = np.flatnonzero(self.blank[ids])
            self._put(inner, np.diff(np.append(first, len(ids))), ids)
        for w in heads:
            ids = np.array(self.bpe.encode_ordinary(w[1:].decode()), np.uint32)
            self._put([w], np.array([len(ids)]), ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, edges) of texts given as bytes and offsets."""
        n = len(offsets) - 1
        is_blank = data == 32
        odd = np.zeros(n, bool)
        two = np.flatnonzero(is_blank[1:] & is_blank[:-1])
        odd[np.searchsorted(offsets, two, "right") - 1] = True  # two blanks in a row, or across texts
        odd[np.searchsorted(offsets, beside_white(data), "right") - 1] = True
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        odd[np.searchsorted(offsets, last[is_blank[last]], "right") - 1] = True
        raw, texts, wholes = data.tobytes(), [], {}
        named = any(name in raw for name in self.names)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            text = raw[a:b]
            if odd[i] or named and any(name in text for name in self.names):
                wholes[i] = np.array(self.bpe.encode(text.decode(), allowed_special="all"), np.uint32)
                texts.append([])
            elif text:
                first, *rest = text.split(b" ")
                texts.append([self.FIRST + first, *rest])
            else:
                texts.append([])
        ids, upto = self.ids(list(chain.from_iterable(texts)))
        edges = upto[np.cumsum([0, *map(len, texts)])]
        if not wholes:
            return ids, edges
        parts = [wholes[i] if i in wholes else ids[edges[i] : edges[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(ranks_file: str, pattern: str, specials: dict[str, int]) -> WordEncoder:
    key = repr((ranks_file, pattern, specials))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(ranks_file, pattern, specials)
    return _ENCODERS[key]


def cuts(n: int, capacity: int, classes: int, fill: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens, in order.  Class ``classes + 1`` is for rests."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k > classes:
            pieces.append((rest, classes + 1))
            break
        if rest >= fill * (capacity // k) or k == classes:
            pieces.append((rest, k))
            break
        slot = capacity // (k + 1)
        pieces.append((slot, k + 1))
        rest -= slot
    return pieces


class Bins:
    """The open bins of one task.  ``put`` returns the rows of a bin that it closes."""

    def __init__(self, capacity: int, classes: int, first_id: int):
        self.capacity, self.classes, self.next = capacity, classes, first_id
        self.open: dict[int, list[tuple]] = {}
        self.filled = 0  # tokens in the open bin of small rests

    def _close(self, rows: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for row in rows:
            out.append((*row, self.next, offset))
            offset += row[2]
        self.next += 1
        return out

    def put(self, kind: int, row: tuple) -> list[tuple]:
        """row: (document, start, length, ...)"""
        rows, closed = self.open.setdefault(kind, []), []
        if kind > self.classes:
            if self.filled + row[2] > self.capacity:
                closed, self.open[kind], self.filled = self._close(rows), [], 0
                rows = self.open[kind]
            self.filled += row[2]
        rows.append(row)
        if kind <= self.classes and len(rows) == kind:
            closed = self._close(self.open.pop(kind))
        return closed

    def rest(self) -> list[tuple]:
        """The pieces of bins that are still open share bins, the longest first."""
        bins: list[list[tuple]] = []
        for row in sorted((r for rows in self.open.values() for r in rows), key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1])):
            for b in bins:
                if sum(r[2] for r in b) + row[2] <= self.capacity:
                    b.append(row)
                    break
            else:
                bins.append([row])
        self.open, self.filled = {}, 0
        return [x for b in bins for x in self._close(b)]


def pack_documents(
    df: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    fill: float = FILL,
    with_ids: bool = False,
    specials: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``start`` counts its document's ids before the piece, ``offset`` those
    before it in the sequence; ``ids_crc32`` covers the ids as little-endian
    unsigned 32-bit numbers.  ``specials`` are names that stand for an id of their
    own wherever a text has them.  Null and empty texts are their end id alone.
    Equal rows are packed each on its own, a null id stays null, further
    columns are ignored, and an empty table gives an empty table.
    """
    fields = [pa.field(id_col, pa.int64()), *(pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        # rows: id, start, length, crc, tokens, ids, sequence, offset
        c = list(zip(*rows)) if rows else [()] * 8
        columns = [pa.array(c[i], pa.int64()) for i in (0, 1, 2, 3, 4, 6, 7)]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in c[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bins = Bins(capacity, classes, (task.partitionId() if task else 0) << 33)
        enc = encoder(ranks_file, pattern, specials or {})
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in slices(batch.column(1), 300_000):
                out = []
                all_ids, edges = enc.encode(data, offsets)
                for name, a, b in zip(names[i:j], edges[:-1].tolist(), edges[1:].tolist()):
                    ids = np.append(all_ids[a:b], np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for length, kind in cuts(len(ids), capacity, classes, fill):
                        piece = ids[start : start + length]
                        out += bins.put(kind, (name, start, length, zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None))
                        start += length
                if out:
                    yield table(out)
        yield table(bins.rest())

    return df.select(df[id_col].cast("long").alias(id_col), df[text_col].cast("string").alias(text_col)).mapInArrow(work, _ddl(schema))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'array<int>' if pa.types.is_list(f.type) else 'bigint'}" for f in schema)
