"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Every row gets a global number, a keyed permutation of ``0 .. N-1`` maps it to
a position, and position ``p`` goes to shard ``p mod S``, slot ``p div S``.
Shard sizes differ by one row at most, slots have no gaps, and where any row
goes follows from its number, ``N`` and the key alone.

DataFrame functions only.  The permutation works on the next power of two; a
value that falls outside ``0 .. N-1`` is permuted again until it falls inside
(cycle walking), which keeps the map one-to-one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647
ROUNDS = 6
#: A walk takes one more step with a probability below one half.
WALK = 96
#: Rows in a numbering cell, on average; no cell is ordered as a whole corpus.
CELL_ROWS = 50_000
MAX_CELLS = 65_536


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and summand of each round, by a linear congruence from the seed."""
    keys, x = [], (seed * 2654435761 + 97) % PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 48271 + 11) % PRIME
            pair.append(x + 1)
        keys.append((pair[0], pair[1]))
    return keys


def permute(x: Column, n: int, seed: int) -> Column:
    """Position of row number ``x`` (0 .. n-1) under the keyed permutation of 0 .. n-1.

    Defined for n up to 2^62; n of 0 or 1 gives ``x``.
    """
    if n <= 1:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    bits = max(2, (n - 1).bit_length())
    left = bits - half  # bits of the left part; the right part has ``half`` or as many
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(i % 2).alias("odd")) for i, (a, b) in enumerate(round_keys(seed))])

    def once(v: Column) -> Column:
        start = F.struct(F.shiftright(v, half).alias("l"), v.bitwiseAND((1 << half) - 1).alias("r"))

        def step(s: Column, k: Column) -> Column:
            def f(part: Column, width: int) -> Column:
                t = (part % F.lit(PRIME) * k["a"] + k["b"]) % F.lit(PRIME)
                return F.shiftright((t * t + k["a"]) % F.lit(PRIME), 3).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

            # halves of unlike width are altered in turn, which any widths allow
            return F.struct(
                F.when(k["odd"] == 0, s["l"].bitwiseXOR(f(s["r"], left))).otherwise(s["l"]).alias("l"),
                F.when(k["odd"] == 1, s["r"].bitwiseXOR(f(s["l"], half))).otherwise(s["r"]).alias("r"),
            )

        return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit(f"a cycle is longer than {WALK} steps: choose another seed")).cast("long"))


def number_rows(df: DataFrame, key: str, column: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with a global row number 0 .. N-1 that depends on its rows alone, and N.

    ``key`` is a whole number (null counts as -1).  Rows are dealt to cells by
    a hash of all columns, so that one key, or null, makes no hot cell; cells
    follow one another, and a cell is ordered by key and then by the others.  Equal rows are merged with a count before
    they are dealt, so that repeats make no hot cell; they get neighbouring
    numbers.  Pass the few columns that matter, not the texts.
    """
    cols = df.columns
    total = df.count()
    cells = max(1, min(MAX_CELLS, total // CELL_ROWS))
    groups = df.groupBy(*cols).agg(F.count("*").alias("__n")).withColumn("__cell", F.pmod(F.xxhash64(*cols), F.lit(cells)))
    # a row for each cell: MAX_CELLS bounds what is held here
    sizes = groups.groupBy("__cell").agg(F.sum("__n").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__from", F.coalesce(before, F.lit(0))).drop("__rows")
    inside = Window.partitionBy("__cell").orderBy(F.coalesce(F.col(key).cast("long"), F.lit(-1)), *[c for c in cols if c != key])
    run = F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = groups.withColumn("__at", run).join(F.broadcast(offsets), "__cell")
    first = F.col("__from") + F.col("__at")
    each = F.explode(F.sequence(first, first + F.col("__n") - 1))
    return numbered.select(*cols, each.alias(column)), total


def feistel_shards(df: DataFrame, key: str, shards: int, seed: int = 1) -> DataFrame:
    """``df`` with row_number, position, shard and slot.

    Null keys count as -1; an empty table stays empty; equal rows get numbers
    of their own.  Columns of those names in ``df`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    names = ("row_number", "position", "shard", "slot")
    rows, n = number_rows(df.drop(*names), key)
    return (
        rows.withColumn("position", permute(F.col("row_number"), n, seed))
        .withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("slot", F.expr(f"position div {shards}"))
    )
