"""A stored inverted index: BM25 searches read the postings of their terms and nothing else.

An index is a folder of segments and a state that lists them.  A segment's
documents are dealt to ranges of a bounded number, and ranges to slices.  A
segment holds its documents' lengths and, by a hash of the term, a row for each
term and slice: document numbers, weighted frequencies and lengths as packed
numbers in the order of ranges, and for each range the number of its postings
(a block) and, as a bound, the largest share of a score among them.  Inserts
add a segment.  Deletes and replacements add a table of dead numbers that
counts for all older segments.  ``merge`` makes one segment of what is alive.

A search first adds up bounds over the blocks of each range, which takes no
postings.  The ranges with the highest bounds are scored; the kth score found
there is each query's threshold, and of the other ranges only those are scored
whose bound reaches it.  Queries of many terms, whose bounds add up to more
than any document has, are scored over all blocks of their terms at once; the
rows are the same either way.  Postings of a slice meet in one task and are
added up there in numpy; the number of tasks follows the number of postings.
"""

from __future__ import annotations

import itertools
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import ACCENTED, PLAIN, query_terms, words
from textloom.operators.bm25 import B, K1, LEAST_IDF, WEIGHTS, terms_of, top
from textloom.storage import Folder, shared_root

#: Raised when what is stored changes its form: older indexes are then built anew.
FORMAT = 2
#: Documents of a range on average, folders of term hashes, and ranges of a query that are scored for its threshold.
RANGE_DOCS, BUCKETS, FIRST = 256, 16, 8
#: Ranges of a slice.
SLICE = 16
SLACK = 2e-6
#: Terms of a query up to which bounds are tried.
FEW_TERMS = 6
#: Postings of a task on average, and bytes of text that are counted at once.
TASK_POSTINGS, COUNT_BYTES = 1_000_000, 8 << 20

COUNTED = "bucket int, slice int, at int, n int, terms array<string>, sizes array<int>, gaps binary, tfs binary, lengths binary"
LIST = "term string, slice int, n int, ranges array<int>, counts array<int>, bests array<double>, gaps binary, tfs binary, lengths binary, bucket int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _tasks(postings: int | None) -> int:
    """Tasks for so many postings."""
    return max(1, -(-(postings or 0) // TASK_POSTINGS))


def impact(tf, length, mean):
    """A term's share of a score, without its idf: grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """pmod(xxhash64(key), ranges), as Spark gives it."""
    u = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, (42 + 0x27D4EB2F165667C5 + 8) & (1 << 64) - 1)]
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = u[4] ^ turn(key.astype(np.uint64) * u[1], 31) * u[0]
    h = turn(h, 27) * u[0] + u[3]
    for bits, factor in ((33, u[1]), (29, u[2])):
        h = (h ^ h >> np.uint64(bits)) * factor
    return (h ^ h >> np.uint64(32)).astype(np.int64) % ranges


# ------------------------------------------------------------ packed numbers


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _packed(starts: np.ndarray, key: np.ndarray, tf: np.ndarray, length: np.ndarray) -> list[pa.Array]:
    """gaps, tfs and lengths of rows that begin at ``starts``: the first key, then differences."""
    gaps = np.diff(key, prepend=0)
    gaps[starts] = key[starts]
    out = []
    for x, t in ((gaps, np.int64), (tf, np.float64), (length, np.int32)):
        ends = (np.append(starts, len(key)) * t().itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, t))]))
    return out


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each posting, key, tf, length) of rows with gaps, tfs and lengths."""
    out = []
    for name, t in (("gaps", np.int64), ("tfs", np.float64), ("lengths", np.int32)):
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        out.append(np.frombuffer(column.buffers()[2], t, (ends[-1] - ends[0]) // t().itemsize, int(ends[0])))
        sizes = np.diff(ends) // t().itemsize
    total = np.concatenate([[0], np.cumsum(out[0])])
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, total[1:] - total[np.cumsum(sizes) - sizes][row], out[1], out[2]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    other = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _together(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows in their order, cut only where one of the columns (whole numbers) changes."""
    rest: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if not rest and batch is None:
            return
        rows = pa.Table.from_batches(rest + ([batch] if batch is not None else []))
        whole = rows.num_rows if batch is None else int(_starts(*[rows.column(n).to_numpy() for n in names])[-1])
        if whole:
            yield rows.slice(0, whole).combine_chunks()
        rest = rows.slice(whole).to_batches()


def _dealt(at: np.ndarray, bucket: np.ndarray, part: np.ndarray, code: np.ndarray, names: pa.Array, key: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Postings as rows of COUNTED: a row for each segment, folder and slice."""
    group = (at.astype(np.int64) * BUCKETS + bucket << 36) + part
    order = np.lexsort((code, group))
    group, code, key, tf, length = (x[order] for x in (group, code, key, tf, length))
    entry, row = _starts(group, code), _starts(group)
    inner = np.searchsorted(entry, row)
    sizes = np.diff(np.append(entry, len(key)))
    first = order[row]
    whole = [pa.array(x, pa.int32()) for x in (bucket[first], part[first], at[first], np.diff(np.append(row, len(key))))]
    lists = [_lists(inner, names.take(pa.array(code[entry]))), _lists(inner, pa.array(sizes, pa.int32()))]
    return pa.RecordBatch.from_arrays([*whole, *lists, *_packed(row, key, tf, length)], names=[c.split()[0] for c in COUNTED.split(", ")])


# ------------------------------------------------------------------ counting

#: Texts with any other characters are cut by Spark's expressions; of the ones here none but Latin-1 has letters or digits.
OTHER = "[\\x{100}-\\x{200F}\\x{2028}-\\x{20AB}\\x{20AD}-\\x{10FFFF}]"


def _folded(byte: int) -> int:
    small = chr(byte).lower()
    small = small.translate(str.maketrans(ACCENTED, PLAIN))
    return ord(small) if unicodedata.category(small)[0] in "LN" else 32


#: What ``words`` makes of each Latin-1 character: small letters without accents, digits, blanks between them.
LATIN = bytes(map(_folded, range(256)))


def latin_terms(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """(terms of each text, all terms as Latin-1 bytes) of texts without OTHER characters, as ``words`` cuts them."""
    raw = [t.encode("latin-1", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(LATIN), np.uint8)
    used = data != 32
    edges = np.flatnonzero(np.diff(used, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[used])])
    return np.diff(np.searchsorted(begin, first)), terms


def _counted(weights: list[float], ranges: int):
    """Rows of COUNTED from key and, for each weight, the text if it is Latin and else its terms.  The row of folder -1
    has the documents with their lengths."""

    def count(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, key = rows.num_rows, rows.column(0).to_numpy()
        owner, codes, weight, names = [], [], [], []
        for i, w in enumerate(weights):
            latin, other = rows.column(1 + 2 * i), rows.column(2 + 2 * i)
            sizes, terms = latin_terms(latin.to_pylist())
            named = terms.dictionary_encode()
            known = pa.array([t.decode("latin-1") for t in named.dictionary.to_pylist()], pa.string())
            more = other.flatten().dictionary_encode()
            held = other.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for size, code, name in ((sizes, named.indices, known), (held, more.indices, more.dictionary)):
                owner.append(np.repeat(np.arange(n), size))
                codes.append(code.to_numpy() + sum(map(len, names)))
                weight.append(np.full(len(code), w))
                names.append(name)
        one = pa.concat_arrays(names).dictionary_encode()
        owner, code = np.concatenate(owner), one.indices.to_numpy()[np.concatenate(codes).astype(np.int64)]
        length, every = np.bincount(owner, minlength=n), max(1, len(one.dictionary))
        yield _documents(key, length)
        if not len(owner):
            return
        pair, back = np.unique(owner * every + code, return_inverse=True)
        tf = np.bincount(back, np.concatenate(weight), len(pair))
        owner, code = pair // every, pair % every
        bucket = np.fromiter((zlib.crc32(t.encode()) % BUCKETS for t in one.dictionary.to_pylist()), np.int64, every)
        part = range_of(key, ranges) // SLICE
        yield _dealt(np.zeros(len(pair), np.int64), bucket[code], part[owner], code, one.dictionary, key[owner], tf, length[owner])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # batches come small enough for their bytes to be looked up at once
            size, a = max(1, batch.nbytes), 0
            step = max(1, int(batch.num_rows * COUNT_BYTES / size))
            while a < batch.num_rows:
                yield from count(batch.slice(a, step))
                a += step

    return run


def _documents(key: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(1, pa.list_(t)) for t in (pa.string(), pa.int32())]
    whole = [pa.array([x], pa.int32()) for x in (-1, 0, 0, len(key))]
    return pa.RecordBatch.from_arrays([*whole, *none, *_packed(np.zeros(1, np.int64), key, np.zeros(len(key)), length)], names=[c.split()[0] for c in COUNTED.split(", ")])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and length from rows of documents."""
    for batch in batches:
        _, key, _, length = _unpacked(batch)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(length)], names=["key", "length"])


# ------------------------------------------------------------------- storing


def _dealt_again(ranges: int):
    """Rows of COUNTED from those of LIST, for other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, key, tf, length = _unpacked(batch)
                at, bucket = (batch.column(c).to_numpy()[row] for c in ("at", "bucket"))
                yield _dealt(at, bucket, range_of(key, ranges) // SLICE, row, batch.column("term"), key, tf, length)

    return run


def _marked(ranges: int):
    """Rows of COUNTED without terms from key and before: dead numbers for each folder of their slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, before = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = range_of(key, ranges) // SLICE
            order = np.argsort(part, kind="stable")
            key, before, part = key[order], before[order], part[order]
            row = _starts(part)
            none = [pa.nulls(len(row), pa.list_(t)) for t in (pa.string(), pa.int32())]
            packed = _packed(row, key, before.astype(np.float64), np.zeros(len(key), np.int32))
            for bucket in range(BUCKETS):
                whole = [pa.array(x, pa.int32()) for x in (np.full(len(row), bucket), part[row], np.zeros(len(row)), np.diff(np.append(row, len(key))))]
                yield pa.RecordBatch.from_arrays([*whole, *none, *packed], names=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def _formed(ranges: int, mean: float):
    """Rows of LIST from those of COUNTED, slice by slice, dead numbers first; postings of one term and key are added up."""

    def form(rows: pa.Table) -> pa.RecordBatch | None:
        dead = rows.column("terms").is_null().to_numpy()
        gone, rows = rows.filter(pa.array(dead)), rows.filter(pa.array(~dead))
        if not rows.num_rows:
            return None
        row, key, tf, length = _unpacked(rows)
        named = rows.column("terms").combine_chunks().flatten().dictionary_encode()
        code = np.repeat(named.indices.to_numpy(), rows.column("sizes").combine_chunks().flatten().to_numpy())
        if gone.num_rows:
            _, k, before, _ = _unpacked(gone)
            order = np.argsort(k)
            k, before = k[order], before[order]
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            alive = (k[at] != key) | (rows.column("at").to_numpy()[row] >= before[at])
            key, tf, length, code = (x[alive] for x in (key, tf, length, code))
            if not len(key):
                return None
        part = range_of(key, ranges)
        order = np.lexsort((key, part, code))
        key, tf, length, code, part = (x[order] for x in (key, tf, length, code, part))
        one = _starts(code, key)
        tf, key, length, code, part = np.add.reduceat(tf, one), key[one], length[one], code[one], part[one]
        block, line = _starts(code, part), _starts(code)
        inner, n = np.searchsorted(block, line), len(line)
        best = np.maximum.reduceat(impact(tf, length, mean), block)
        sizes = np.diff(np.append(block, len(key)))
        lists = [_lists(inner, pa.array(x, t)) for x, t in ((part[block], pa.int32()), (sizes, pa.int32()), (best, pa.float64()))]
        whole = [pa.array(np.diff(np.append(line, len(key))), pa.int32()), *lists, *_packed(line, key, tf, length)]
        same = [pa.array(np.full(n, rows.column(c)[0].as_py()), pa.int32()) for c in ("slice", "bucket")]
        return pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[line])), same[0], *whole, same[1]], names=[c.split()[0] for c in LIST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, ["slice", "bucket"]):
            at = _starts(rows.column("slice").to_numpy(), rows.column("bucket").to_numpy())
            for a, b in zip(at, np.append(at[1:], rows.num_rows)):
                found = form(rows.slice(a, b - a).combine_chunks())
                if found is not None:
                    yield found

    return run


def _stored(rows: DataFrame, postings: int | None, ranges: int, mean: float, path: str) -> None:
    """Write rows of COUNTED as those of LIST with bounds for this mean length.

    Each task has one folder's postings of some slices; more postings make more tasks.
    """
    deals = max(1, min(-(-ranges // SLICE), -(-_tasks(postings) // BUCKETS)))
    dealt = rows.repartitionById(BUCKETS * deals, F.col("bucket") * deals + F.col("slice") % deals)
    ordered = dealt.sortWithinPartitions("bucket", "slice")
    ordered.mapInArrow(_formed(ranges, mean), LIST).write.option("compression", "zstd").partitionBy("bucket").parquet(path)


# ----------------------------------------------------------------- searching

#: Kinds of rows of a slice, in the order in which a task needs them.
DEAD, ALLOWED, POSTED = 0, 1, 2


def _spans(batches: Iterator[pa.RecordBatch], by: str, limited: bool, scope: str | None):
    """(slice's at, rows of postings, dead keys, allowed keys, their scopes) from rows in the order at, slice, kind, ``by``."""
    here, dead, allowed, scopes = None, None, None, None
    for rows in _together(batches, ["at", "slice", "kind", by]):
        at, part, kind = (rows.column(c).to_numpy() for c in ("at", "slice", "kind"))
        start = _starts(at, part, kind)
        for a, b in zip(start, np.append(start[1:], len(at))):
            if here != (at[a], part[a]):
                here, dead, scopes = (at[a], part[a]), None, None
                allowed = np.zeros(0, np.int64) if limited else None
            some = rows.slice(a, b - a).combine_chunks()
            if kind[a] == POSTED:
                yield int(at[a]), some, dead, allowed, scopes
                continue
            keys = some.column("keys").combine_chunks().flatten().to_numpy()
            order = np.argsort(keys, kind="stable")
            if kind[a] == DEAD:
                dead = keys[order]
            else:
                allowed, scopes = keys[order], some.column("scopes").combine_chunks().flatten().take(pa.array(order)) if scope else None


def _among(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.searchsorted(some, key, "right") > np.searchsorted(some, key)


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term and the number of its postings that are alive, for each row."""
    for _, rows, dead, _, _ in _spans(batches, "kind", False, None):
        row, key, _, _ = _unpacked(rows)
        n = np.bincount(row if dead is None else row[~_among(key, dead)], minlength=rows.num_rows)
        yield pa.RecordBatch.from_arrays([rows.column("term").combine_chunks(), pa.array(n)], names=["term", "n"])


def _added(query_id: str, ranges: dict[int, int], mean: float, k: int, limited: bool, scope: str | None):
    """query, key, sum (and scope) of a slice's documents that may be among the k best of a query (and scope)."""

    def add(at: int, rows: pa.Table, dead, allowed, scopes) -> pa.RecordBatch:
        row, key, tf, length = _unpacked(rows)
        asked = rows.column(query_id).combine_chunks().dictionary_encode()
        query, idf, mask = asked.indices.to_numpy(), rows.column("idf").to_numpy(), rows.column("mask").to_numpy()
        keep = np.ones(len(key), bool)
        if (mask >= 0).any():
            keep &= (mask[row] >> range_of(key, ranges[at]) % SLICE & 1).astype(bool)
        if dead is not None:
            keep &= ~_among(key, dead)
        row, key, tf, length = (x[keep] for x in (row, key, tf, length))
        every, place = np.unique(key, return_inverse=True)
        pair = query[row] * np.int64(len(every)) + place
        size = len(asked.dictionary) * len(every)
        total = np.bincount(pair, -idf[row] * impact(tf, length, mean), size)
        pair = np.flatnonzero(np.bincount(pair, minlength=size))
        query, key, total, group = pair // max(1, len(every)), every[pair % max(1, len(every))], total[pair], 0
        if limited:
            low, high = (np.searchsorted(allowed, key, side) for side in ("left", "right"))
            copy = np.repeat(np.arange(len(key)), high - low)
            spot = np.arange(len(copy)) - np.repeat(np.cumsum(high - low) - high, high - low)
            query, key, total = query[copy], key[copy], total[copy]
            if scope:
                group = scopes.dictionary_encode("encode").indices.to_numpy()[spot] if scopes is not None else np.zeros(0, np.int64)
        # what may be rounded to the kth score stays
        order = np.lexsort((total, group + np.zeros(len(query), np.int64), query))
        part = _starts(query[order], (group + np.zeros(len(query), np.int64))[order])
        sizes = np.diff(np.append(part, len(order)))
        kth = total[order[part + np.minimum(sizes, k) - 1]] if len(part) else total
        best = order[total[order] <= np.repeat(kth, sizes) + SLACK]
        columns = [asked.dictionary.take(pa.array(query[best])), pa.array(key[best]), pa.array(total[best])]
        if scope:
            columns.append(scopes.take(pa.array(spot[best])) if scopes is not None else pa.nulls(0, rows.schema.field("scopes").type.value_type))
        return pa.RecordBatch.from_arrays(columns, names=[query_id, "key", "sum", *([scope] if scope else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in _spans(batches, query_id, limited, scope):
            yield add(*span)

    return run


class LexicalIndex:
    """Numbers of documents are whole (``key``); ``columns`` are texts with the weights of their names."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: dict[str, Column], weights: dict[str, float] = WEIGHTS):
        self.spark, self.key, self.columns, self.weights = spark, key, columns, weights
        self.folder = Folder(spark, path)
        self._read: tuple[int, DataFrame | None] = (-1, None)

    # ------------------------------------------------------------- contents

    def state(self) -> dict:
        """Segments and tables of the dead with their order, and what is alive: documents and terms."""
        _, state = self.folder.state()
        return state if state and state["format"] == FORMAT else {"format": FORMAT, "built": False, "next": 0, "segments": [], "dead": [], "docs": 0, "length": 0}

    def _table(self, kind: str, names: list[dict], schema: str) -> DataFrame:
        found = None
        for x in names:
            one = self.spark.read.schema(schema).parquet(f"{self.folder.path}/{x['name']}/{kind}").withColumn("at", F.lit(x["at"]))
            found = one if found is None else found.unionAll(one)
        return self.spark.createDataFrame([], schema + ", at int") if found is None else found

    def _dead(self, state: dict) -> DataFrame:
        """key and the place before which its postings are dead."""
        return self._table("dead", state["dead"], "key bigint").groupBy("key").agg(F.max("at").alias("before"))

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        if not state["dead"]:
            return rows
        gone = self._dead(state)
        return rows.join(gone, (rows["key"] == gone["key"]) & (rows["at"] < gone["before"]), "left_anti")

    def lengths(self, state: dict | None = None) -> DataFrame:
        """key, length of every document that is alive."""
        state = state or self.state()
        return self._alive(self._table("lengths", state["segments"], "key bigint, length int"), state)

    def _blocks(self, state: dict) -> DataFrame:
        """Rows of LIST; what a plan doesn't use isn't read.  The folders of a state are listed once."""
        if self._read[0] != state["next"]:
            self._read = state["next"], self._table("blocks", state["segments"], LIST)
        return self._read[1]

    # -------------------------------------------------------------- changes

    def _segment(self, docs: DataFrame) -> tuple[dict, int, int]:
        """Write a segment: its entry in the state, documents and their terms."""
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.folder.path}/{name}"
        rows = docs.where(F.col(self.key).isNotNull())
        ranges = max(1, rows.count() // RANGE_DOCS)
        texts = []
        for c in self.columns.values():
            text = F.coalesce(c, F.lit(""))
            latin = ~text.rlike(OTHER)
            texts += [F.when(latin, text), F.when(~latin, words(text))]
        rows = rows.select(F.col(self.key).cast("long").alias("key"), *(t.alias(f"t{i}") for i, t in enumerate(texts)))
        rows.mapInArrow(_counted([self.weights[c] for c in self.columns], ranges), COUNTED).write.option("compression", "zstd").parquet(f"{path}/tokens")
        counted = self.spark.read.schema(COUNTED).parquet(f"{path}/tokens")
        counted.where("bucket < 0").mapInArrow(_lengths, "key bigint, length int").write.parquet(f"{path}/lengths")
        n, length = self.spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        postings = counted.where("bucket >= 0").agg(F.sum("n")).first()[0]
        _stored(counted.where("bucket >= 0"), postings, ranges, length / n if length else 1.0, f"{path}/blocks")
        self.folder.drop(f"{name}/tokens")
        return {"name": name, "mean": length / n if length else 1.0, "ranges": ranges}, n, int(length)

    def _change(self, insert: DataFrame | None, remove: DataFrame | None, **more) -> dict:
        number, _ = self.folder.state()
        state = self.state() | more
        if remove is not None and state["segments"]:
            name = f"dead-{uuid.uuid4().hex}"
            gone = self.lengths(state).join(remove.select(F.col(self.key).cast("long").alias("key")).distinct(), "key", "left_semi").select("key", "length")
            gone.write.parquet(f"{self.folder.path}/{name}/dead")
            n, length = self.spark.read.parquet(f"{self.folder.path}/{name}/dead").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            if n:
                state["dead"] = [*state["dead"], {"name": name, "at": state["next"]}]
                state["docs"], state["length"] = state["docs"] - n, state["length"] - int(length)
        if insert is not None:
            entry, n, length = self._segment(insert)
            state["segments"] = [*state["segments"], entry | {"at": state["next"]}]
            state["docs"], state["length"] = state["docs"] + n, state["length"] + length
        state["next"] += 1
        self.folder.commit(number, state)
        return state

    def backfill(self, docs: DataFrame) -> bool:
        """Index all documents, once for each form of the index; whether there was anything to do."""
        if self.state()["built"]:
            return False
        self._change(docs, None, built=True)
        return True

    def insert(self, docs: DataFrame) -> None:
        """Documents whose numbers the index doesn't have."""
        self._change(docs, None)

    def delete(self, keys: DataFrame) -> None:
        self._change(None, keys)

    def replace(self, docs: DataFrame) -> None:
        """Documents anew, whatever the index had of them: changed texts, titles and paths."""
        self._change(docs, docs)

    def merge(self) -> None:
        """One segment of all that is alive; the files of the others go."""
        number, _ = self.folder.state()
        state = self.state()
        if len(state["segments"]) < 2 and not state["dead"]:
            return
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.folder.path}/{name}"
        self.lengths(state).select("key", "length").write.parquet(f"{path}/lengths")
        ranges = max(1, state["docs"] // RANGE_DOCS)
        postings = self._blocks(state).agg(F.sum("n")).first()[0]
        rows = self._blocks(state).select("term", "at", "bucket", "gaps", "tfs", "lengths").mapInArrow(_dealt_again(ranges), COUNTED)
        if state["dead"]:
            rows = rows.unionByName(self._dead(state).select("key", "before").mapInArrow(_marked(ranges), COUNTED))
        _stored(rows, postings, ranges, self.mean(state), f"{path}/blocks")
        self.folder.commit(number, state | {"segments": [{"name": name, "at": state["next"], "mean": self.mean(state), "ranges": ranges}], "dead": [], "next": state["next"] + 1})
        for x in [*state["segments"], *state["dead"]]:
            self.folder.drop(x["name"])

    # --------------------------------------------------------------- search

    def _keys(self, lengths: DataFrame, kind: int, state: dict, scope: str | None = None) -> DataFrame:
        """at, slice, kind, keys (and scopes) of rows with at and key: a row for each slice."""
        ranges = F.create_map(*[F.lit(x) for s in state["segments"] for x in (s["at"], s["ranges"])])
        part = F.floor(F.pmod(F.xxhash64("key"), ranges[F.col("at")]) / SLICE).cast("int")
        held = F.collect_list(F.struct("key", *([F.col(scope).alias("scope")] if scope else [])))
        rows = lengths.groupBy("at", part.alias("slice")).agg(held.alias("x"))
        return rows.select("at", "slice", F.lit(kind).alias("kind"), F.col("x.key").alias("keys"), *([F.col("x.scope").alias("scopes")] if scope else []))

    def _met(self, rows: DataFrame, state: dict, tasks: int, by: str, *marks: DataFrame) -> DataFrame:
        """Rows of postings with the dead and the allowed keys of their slices before them."""
        rows = rows.withColumns({"kind": F.lit(POSTED), "keys": F.lit(None).cast("array<bigint>")})
        if state["dead"]:
            lengths = self._table("lengths", state["segments"], "key bigint, length int")
            gone = lengths.join(self._dead(state), "key").where("at < before")
            marks = self._keys(gone, DEAD, state), *marks
        for m in marks:
            rows = rows.unionByName(m, allowMissingColumns=True)
        # slices are numbered over the segments and dealt in turn, so that tasks have the same number of them but for one
        sizes = [-(-s["ranges"] // SLICE) for s in state["segments"]]
        before = F.create_map(*[F.lit(x) for s, n in zip(state["segments"], np.cumsum([0, *sizes]).tolist()) for x in (s["at"], n)])
        tasks = min(tasks, sum(sizes))
        return rows.repartitionById(tasks, ((before[F.col("at")] + F.col("slice")) % tasks).cast("int")).sortWithinPartitions("at", "slice", "kind", by)

    def asked(self, queries: DataFrame, query_id: str, query_text: str, state: dict) -> DataFrame:
        """query, term, bucket, idf, df and whether the query has many terms; terms that no document has are left out.

        Written to the application's folder: a search uses it several times.
        """
        terms = terms_of(queries, query_id, query_text).withColumn("bucket", _bucket(F.col("term")))
        many = queries.select(query_id, (F.size(query_terms(F.col(query_text))) > FEW_TERMS).alias("many"))
        used = terms.select("term", "bucket").distinct()
        if state["dead"]:
            held = self._blocks(state).join(used, ["bucket", "term"], "left_semi")
            tasks = _tasks(held.agg(F.sum("n")).first()[0])
            met = self._met(held.select("at", "slice", "term", "gaps", "tfs", "lengths"), state, tasks, "kind")
            often = met.mapInArrow(_living, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0").withColumn("bucket", _bucket(F.col("term")))
        else:
            often = self._blocks(state).join(used, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        docs = F.lit(float(state["docs"]))
        idf = F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        found = terms.join(often, ["bucket", "term"]).join(many, query_id).select(query_id, "bucket", "term", idf.alias("idf"), "df", "many")
        path = f"{shared_root(self.spark)}/asked-{uuid.uuid4().hex}"
        found.write.parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def scored(self, rows: DataFrame, query_id: str, k: int, state: dict, tasks: int, only: DataFrame | None = None, scope: str | None = None) -> DataFrame:
        """query, key, score (and scope) of what may be among the k best, from rows of LIST that carry a query, an idf and a
        mask of the ranges to score, in so many tasks.  ``only`` has the keys that are asked for, and their scopes."""
        marks = []
        if only is not None and state["segments"]:
            keys = only.select(F.col(self.key).cast("long").alias("key"), *([scope] if scope else []))
            marks = [self._keys(self.lengths(state).join(keys if scope else keys.distinct(), "key"), ALLOWED, state, scope)]
        rows = rows.select("at", "slice", query_id, "idf", "mask", "gaps", "tfs", "lengths")
        kind = dict(rows.dtypes)[query_id]
        more = f", {scope} {dict(only.dtypes)[scope]}" if scope else ""
        if not state["segments"]:
            return self.spark.createDataFrame([], f"{query_id} {kind}, key bigint, score double{more}")
        add = _added(query_id, {s["at"]: s["ranges"] for s in state["segments"]}, self.mean(state), k, only is not None, scope)
        found = self._met(rows, state, tasks, query_id, *marks).mapInArrow(add, f"{query_id} {kind}, key bigint, sum double{more}")
        return found.withColumn("sum", F.round("sum", 6)).withColumnRenamed("sum", "score")

    @staticmethod
    def mean(state: dict) -> float:
        return state["length"] / state["docs"] if state["docs"] and state["length"] else 1.0

    def candidates(self, asked: DataFrame, query_id: str, k: int, state: dict, only: DataFrame | None = None) -> DataFrame:
        """query, at, range: where the k best of each query are, by bounds and thresholds."""
        # bounds are for the mean length when a segment was written: a share grows at most as the mean does
        grown = F.create_map(*[F.lit(x) for s in state["segments"] for x in (s["at"], max(1.0, self.mean(state) / s["mean"]))]) if state["segments"] else F.create_map(F.lit(0), F.lit(1.0))
        bound = F.col("idf") * F.col("best") * grown[F.col("at")]
        bounds = self._each(asked, state).groupBy(query_id, "at", "range").agg(F.sum(bound).alias("bound"))
        first = top(bounds, [query_id], [F.desc("bound"), F.col("at"), F.col("range")], FIRST).select(query_id, "at", "range")
        found = self.scored(self._of(first, asked, query_id, state), query_id, k, state, self._reads(asked), only)
        # scores are below zero: the kth is the greatest of the k least
        kth = top(found, [query_id], [F.col("score"), F.col("key")], k).groupBy(query_id).agg(F.max("score").alias("kth"), F.count("*").alias("found"))
        reach = bounds.join(kth.where(F.col("found") == k), query_id, "left")
        return reach.where(F.col("kth").isNull() | (F.col("bound") + SLACK >= -F.col("kth"))).select(query_id, "at", "range")

    @staticmethod
    def _reads(asked: DataFrame) -> int:
        """Tasks for all postings of what is asked."""
        return _tasks(asked.agg(F.sum("df")).first()[0])

    def _each(self, asked: DataFrame, state: dict) -> DataFrame:
        """The blocks of the terms that are asked for: range and best."""
        rows = self._blocks(state).join(asked, ["bucket", "term"])
        return rows.withColumn("x", F.explode(F.arrays_zip("ranges", "bests"))).withColumns({"range": F.col("x.ranges"), "best": F.col("x.bests")}).drop("x")

    def _of(self, ranges: DataFrame, asked: DataFrame, query_id: str, state: dict) -> DataFrame:
        """Rows of LIST with a mask of these ranges (query, at, range)."""
        masks = ranges.groupBy(query_id, "at", F.expr(f"cast(range div {SLICE} as int)").alias("slice")).agg(F.expr(f"bit_or(shiftleft(1, range % {SLICE}))").alias("mask"))
        return self._blocks(state).join(asked, ["bucket", "term"]).join(masks, [query_id, "at", "slice"])

    def _all(self, asked: DataFrame, state: dict) -> DataFrame:
        return self._blocks(state).join(asked, ["bucket", "term"]).withColumn("mask", F.lit(-1))

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, only: DataFrame | None = None) -> DataFrame:
        """query, rank, key and score of the k best documents of each query, as ``bm25.search`` gives them."""
        state = self.state()
        asked = self.asked(queries, query_id, query_text, state)
        few, many = asked.where("not many"), asked.where("many")
        some = self._of(self.candidates(few, query_id, k, state, only), few, query_id, state)
        best = self.scored(some.unionByName(self._all(many, state), allowMissingColumns=True), query_id, k, state, self._reads(asked), only)
        return top(best, [query_id], [F.col("score"), F.col("key")], k).withColumnRenamed("key", self.key).select(query_id, self.key, "score", "rank")

    def search_scopes(self, queries: DataFrame, query_id: str, query_text: str, scopes: DataFrame, scope: str, k: int) -> DataFrame:
        """query, scope, rank, key and score: the k best of each scope (key, scope).  A scope's kth score isn't known
        from bounds over all documents, so that all blocks of the terms are read."""
        state = self.state()
        asked = self.asked(queries, query_id, query_text, state)
        hits = self.scored(self._all(asked, state), query_id, k, state, self._reads(asked), scopes, scope)
        return top(hits, [query_id, scope], [F.col("score"), F.col("key")], k).withColumnRenamed("key", self.key).select(query_id, scope, self.key, "score", "rank")

    def reads(self, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
        """For queries of few terms: query, blocks of its terms, and those of them that a search reads."""
        state = self.state()
        asked = self.asked(queries, query_id, query_text, state)
        asked = asked.where("not many")
        blocks = self._each(asked, state)
        kept = self.candidates(asked, query_id, k, state).withColumn("read", F.lit(1))
        return blocks.join(kept, [query_id, "at", "range"], "left").groupBy(query_id).agg(F.count("*").alias("blocks"), F.count("read").alias("read"))
