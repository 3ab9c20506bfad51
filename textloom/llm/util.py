"""What several operators share: staged tables, joins on hot keys, components, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Staged tables
# --------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is used if all runs on one
    machine; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.TemporaryDirectory(prefix="textloom-")
        atexit.register(_LOCAL.cleanup)
    return "file://" + _LOCAL.name


_LOCAL: tempfile.TemporaryDirectory | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of the application's own."""
    return f"{shared_root(spark)}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage in a way that outlives executors, so that a later action
    reads rows instead of repeating the work (or repeating it differently).
    The table stays for as long as its rows may be asked for: until the scope
    that it was made in ends, or with the application's folder.
    """
    path = scratch(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return _stage(df, path)


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was staged in it; results must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Staged tables of one run of an operator, all deleted when it is left.

    What is given back must not read them: stage the result outside.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.number = spark, scratch(spark, name), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.path)

    def fresh(self, name: str) -> str:
        self.number += 1
        return f"{self.path}/{self.number}-{name}"

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return _stage(df, self.fresh(name))


# What Arrow frees goes back to the system, not to a pool that each worker would keep for as long as it lives.
pa.set_memory_pool(pa.system_memory_pool())

#: Rows of an Arrow batch between executor and Python worker, where rows hold whole texts or sets.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows for each Arrow batch to BATCH_ROWS, unless it has a value of its own: ten thousand texts,
    the default, take hundreds of megabytes in each worker where some are very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


# --------------------------------------------------------------------------
# Joins on hot keys
# --------------------------------------------------------------------------

#: Rows of a key from which they are spread, and keys that are spread at most, the largest ones: what is broadcast
#: has a row of a key and a number for each.
HOT_ROWS, HOT_KEYS = 5_000, 100_000


def hot_keys(counted: DataFrame, keys: list[str], n: str, rows: int) -> DataFrame:
    """Keys of ``counted`` (a row for each, with its number of rows ``n``) that are spread, and over how many copies."""
    top = counted.where(F.col(n) > rows).orderBy(F.desc(n), *keys).limit(HOT_KEYS)
    return top.select(*keys, F.ceil(F.col(n) / rows).cast("int").alias("__copies"))


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], counted: DataFrame | None = None, n: str = "n", how: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` on ``keys``, where a key may hold any share of ``rows``.

    ``counted`` (``facts`` itself, if it has the column ``n``) tells how many
    rows each key has.  Rows of a hot key are dealt to salts by the columns
    ``by``; its facts are copied to each salt.
    """
    rows_each = most or HOT_ROWS
    few = F.broadcast(hot_keys(facts if counted is None else counted, keys, n, rows_each))  # HOT_KEYS bounds it
    salt = F.when(F.col("__copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__copies"))).cast("int")
    left = rows.join(few, keys, "left").withColumn("__salt", salt).drop("__copies")
    # facts that tell their own rows need no join for their copies; beyond HOT_KEYS, copies but the first meet nothing
    right = facts.join(few, keys, "left") if counted is not None else facts.withColumn("__copies", F.when(F.col(n) > rows_each, F.ceil(F.col(n) / rows_each).cast("int"))).drop(n)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies"), F.lit(1)) - 1))).drop("__copies")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


# --------------------------------------------------------------------------
# Connected components
# --------------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str, space: Workspace | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    Alternating large-star and small-star rounds; each is a grouping on node
    ids with map-side ``min``, whose counts tell the hot nodes, the centres of
    large stars.  The state is staged after each star and the one before it
    deleted, so that no plan holds more than one of them: a plan of both has
    nine copies of the first, which the driver pays for however few the edges.
    The loop ends when a round changes nothing, and doesn't begin without edges.
    Rounds grow with the logarithm of the number of nodes.  Null ends and self
    loops are ignored.  What is given back is read from ``space``, if there is one.
    """
    spark = edges.sparkSession
    fresh = space.fresh if space else lambda name: scratch(spark, name)
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    path = fresh("components")
    e = _stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), path)

    def moved(to: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, fresh("components")
        to = _stage(to, path)
        discard(spark, old)
        return to

    before = state(e)
    while before["n"]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        # large star: greater neighbours move to the smallest node around
        e = moved(spread_join(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours and the node itself do
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        e = moved(
            spread_join(e, low, ["u"], ["v"])
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        after = state(e)
        if after == before:
            break
        before = after
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(pairs.select(F.col("component").alias("node"), "component").distinct())


# --------------------------------------------------------------------------
# Words and hashes
# --------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of length n + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 500_000):
    """(first row, last row, bytes, offsets) pieces of about ``most`` bytes; texts stay whole."""
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: Bytes of a word after which its powers start anew, and bytes of text that are hashed at once.
PERIOD, PIECE = 1 << 16, 1 << 20


def powers(n: int) -> np.ndarray:
    """Factors of the first ``n`` bytes of a word; ``n`` is at most PERIOD."""
    return _POWERS[:n]


_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PERIOD - 1, _BASE, np.uint64)]), dtype=np.uint64)


def pieces(data: np.ndarray, space: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of at least ``most`` bytes that end where a byte of ``space`` begins the next."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + most)
        while b < n:
            found = np.flatnonzero(space[data[b : b + most]])
            if len(found):
                b += int(found[0])
                break
            b = min(n, b + most)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; bytes, end exclusive.

    ``space`` and ``fold`` tell for each byte whether it parts words and what it counts as.
    Long texts are hashed piece by piece, cut between words.
    """
    if len(data) <= PIECE:
        return _hashes(data, offsets, space, fold)
    found = []
    for a, b in pieces(data, space, PIECE):
        h, doc, starts, ends = _hashes(data[a:b], np.clip(offsets - a, 0, b - a), space, fold)
        found.append((h, doc, starts + a, ends + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def _hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    ink = ~space[data]
    before = np.empty(len(ink), bool)
    before[0], before[1:] = False, ink[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(ink & ~before)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    after = np.empty(len(ink), bool)
    after[-1], after[:-1] = False, ink[1:]
    after[inner[(inner > 0) & (inner <= len(data))] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    at = np.arange(starts[0], len(data), dtype=np.int32)
    at -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    rest = data[starts[0] :]
    # a word beyond the period goes on with the same powers of another value, which no short word has
    longest = int((ends - starts).max())
    values = fold[rest].astype(np.uint64) + np.uint64(1)
    if longest > PERIOD:
        values += (at >> 16).astype(np.uint64) << np.uint64(9)
        at &= PERIOD - 1
    else:
        np.minimum(at, longest - 1, out=at)
    values *= _POWERS[at]
    # each byte's share is mixed before shares are added up: sums of powers alone are equal for words built for it
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    values[~ink[starts[0] :]] = 0
    h = np.add.reduceat(values, starts - starts[0])
    h = mix(h + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(offsets, starts, "right") - 1, starts, ends
