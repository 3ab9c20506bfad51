"""Jaccard self-join of documents on word shingles, with adaptive multi-match prefixes.

Sets are ordered by a global order of their tokens.  A set of ``n`` tokens that
links with another shares at least ``o = ceil(0.75 n)`` tokens with it, and so
at least ``l`` among the first ``n - o + l`` of each, for any ``l``: a longer
prefix asks for correspondingly more shared tokens before a pair is verified.

1. ``screened``: in the order of the tokens' hashes, which needs no counts, each
   document sends the prefix for an eighth of its tokens.  Those of which fewer
   than that eighth occur in any other document's prefix have no partner.
2. ``profiles``: what is left is ordered by document frequency, counted over all
   of it, and each document chooses ``l`` where the estimated cost is least: the
   postings that its prefix reads, and the verifications that so many matches
   leave.
3. ``met``: (token, document) rows of these prefixes.  Each token elects leaders,
   a document meets the leaders of its tokens, and pairs that share as many
   prefix tokens as the smaller ``l`` asks for are verified.  What these links
   connect is one part, so that a group of any size costs a few comparisons for
   each member.
4. ``links_between``: tokens that several parts have are searched without leaders:
   their documents meet in cells, where shared prefix tokens are counted and what
   passes is verified, in blocks of bounded size.

Equal sets are one class from the start.  No pair that the prefixes allow is left
out, and a token, class or leader that very many documents have is spread over
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.util import HOT_KEYS, Workspace, components, mix, slices, small_batches, spread_join, staged, word_hashes

WORDS = 5
#: Similarity from which documents link, in hundredths.
SIMILAR = 75
#: Share of a document's tokens, one in so many, that its first prefix asks to find elsewhere.
SCREEN = 8
#: Matches that a document may ask for in the second prefixes, and what a verification costs in steps over a posting.
LEVELS, VERIFY = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 40
#: Leaders of a token.
SEEDS = 3
#: Documents and bytes of tokens of a block of a cell, about.
CELL_DOCS, CELL_BYTES = 400, 8 << 20
#: Prefix tokens that a task gathers before it merges what its documents share; tokens in one row.
SLICE_TOKENS, ROW_TOKENS = 500_000, 20_000
#: Documents that a task gathers before it hands them on, equal ones among them.
SLICE_DOCS = 100_000
#: One in so many rows is read ahead for tokens that very many slices have, and how often such a token is seen there.
AHEAD, OFTEN = 64, 8
#: Survivors up to which their ids are broadcast (eight bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def overlap(n):
    """Tokens that a set of ``n`` shares with any set it links with."""
    return -(-SIMILAR * n // 100)


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text.

    A text of fewer words than a shingle has one, the whole; one without words has none.
    """
    h, doc, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=n)
    edges = np.concatenate([[0], np.cumsum(per_doc)])
    factors = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    m = len(h)
    if m >= WORDS:
        s = h[: m - WORDS + 1] * factors[0]
        for k in range(1, WORDS):
            s += h[k : m - WORDS + 1 + k] * factors[k]
        s = mix(s)
    out = []
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums that tell a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s).sum(dtype=np.uint64).view(np.int64))


# ------------------------------------------------------------- first prefixes

SCREEN_DDL = "doc bigint, n int, s1 bigint, s2 bigint, docs array<bigint>, here int, tokens array<bigint>"
SCREENED = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("docs", pa.list_(pa.int64())), ("here", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def extra(n):
    """Tokens that the first prefix of ``n`` tokens has beyond what the overlap leaves out."""
    return n // SCREEN + 1


def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set that a slice of documents holds: one of them, its size and sums, all of them, how many of
    its prefix tokens other sets of the slice have, and the rest of its prefix tokens.

    A token that several sets of the slice have goes on once, in rows without
    a document, so that a token of very many documents makes few rows.
    """
    held: dict[tuple, list[int]] = {}
    prefixes: dict[tuple, np.ndarray] = {}
    size = number = 0

    def done() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        length = np.array([len(prefixes[k]) for k in keys], np.int64)
        flat = np.concatenate([prefixes[k] for k in keys])
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        times = np.diff(np.append(np.flatnonzero(fresh), len(ordered)))
        several = np.zeros(len(flat), bool)
        several[order] = np.repeat(times, times) > 1
        owner = np.repeat(np.arange(len(keys)), length)
        here = np.bincount(owner[several], minlength=len(keys)).astype(np.int32)
        own = np.bincount(owner[~several], minlength=len(keys))
        list_of = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
        ends = np.concatenate([[0], np.cumsum(own)])
        docs = [held[k] for k in keys]
        c = list(zip(*keys))
        yield pa.RecordBatch.from_arrays([pa.array([min(d) for d in docs], pa.int64()), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(docs, pa.list_(pa.int64())), pa.array(here), list_of(ends, _signed(flat[~several]))], schema=SCREENED)
        shared = _signed(ordered[fresh][times > 1])
        ends = np.append(np.arange(0, len(shared), ROW_TOKENS), len(shared))
        if len(shared):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(ends) - 1, SCREENED.field(i).type) for i in range(6)), list_of(ends, shared)], schema=SCREENED)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in slices(batch.column(1)):
            for doc, s in zip(ids[i:j].tolist(), sets(data, offsets)):
                key = (len(s), *_sums(s))
                number += 1
                if key in held:
                    held[key].append(doc)
                    continue
                held[key] = [doc]
                prefixes[key] = s[: len(s) - overlap(len(s)) + extra(len(s))].copy()
                size += len(prefixes[key])
            if size >= SLICE_TOKENS or number >= SLICE_DOCS:
                yield from done()
                held, prefixes, size, number = {}, {}, 0, 0
    if held:
        yield from done()


def survivors(first: DataFrame) -> DataFrame:
    """(doc, s1) of the sets of which enough prefix tokens occur elsewhere.

    A partner may have three quarters of the tokens, and then as much shorter a
    prefix: what such a partner adds to its own is what must be found.

    Tokens that very many slices have are told by reading some rows ahead: what
    is seen there several times occurs elsewhere for certain, so that its rows
    are found without being gathered.  All other tokens are counted exactly.
    """
    tokens = first.select("doc", "s1", F.explode("tokens").alias("token"))
    some = first.where(F.pmod(F.xxhash64("doc", F.get("tokens", F.lit(0))), F.lit(AHEAD)) == 0)
    often = some.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    often = F.broadcast(often.orderBy(F.desc("n"), "token").limit(HOT_KEYS).select("token", F.lit(True).alias("seen")))
    told = tokens.join(often, "token", "left")
    rest = told.where("seen is null").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("c > 1")
    found = told.where("seen").select("doc", "s1").unionAll(rest.select("doc", "s1")).where("doc is not null")
    elsewhere = found.groupBy("doc", "s1").agg(F.count("*").alias("shared")).select("doc", "s1", F.lit(0).alias("n"), "shared")
    here = first.where("n > 0").select("doc", "s1", "n", F.col("here").cast("long").alias("shared"))
    total = here.unionAll(elsewhere).groupBy("doc", "s1").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"))
    least = F.expr(f"(n * {SIMILAR} + 99) div 100 div {SCREEN} + 1")
    return total.where(F.col("shared") >= least).select("doc", "s1")


# ------------------------------------------------------------ second prefixes


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, s1, n and tokens of each text."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            found = sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([_sums(x)[0] for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([_signed(x) for x in found], pa.list_(pa.int64()))], names=["doc", "s1", "n", "set"]
            )


PROFILE_DDL = "doc bigint, n int, k int, tokens binary, prefix array<bigint>"


def chosen_prefix(n: int, tokens: np.ndarray, often: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The matches ``k`` that a set of ``n`` tokens asks for and its prefix, from its shared tokens in the global order.

    With ``free`` shared tokens more than the overlap needs, the prefix for ``k``
    matches is the first ``free + k`` of them; tokens of its own would come before
    and match nothing.  None if too few are shared for any link.
    """
    need = overlap(n)
    if len(tokens) < need:
        return None
    steps = np.cumsum(often - 1)
    free = len(tokens) - need
    k = min((steps[free + k - 1] * (1 + VERIFY / k**2), k) for k in LEVELS if k <= need)[1]
    return k, tokens[: free + k]


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document that may link, from rows (doc, s1, n, frequency, token) that come set by set and in the
    global order: its size, matches to ask for, shared tokens and prefix."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    out: list[tuple] = []

    def put(c: list[np.ndarray]) -> None:
        found = chosen_prefix(int(c[2][0]), c[4], c[3])
        if found:
            out.append((int(c[0][0]), int(c[2][0]), found[0], c[4].tobytes(), found[1]))

    def flush() -> pa.RecordBatch:
        c = list(zip(*out)) if out else [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=["doc", "n", "k", "tokens", "prefix"])

    held: list[list[np.ndarray]] = []  # parts of the set that the last batch ended in
    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(c[0]):
            continue
        cuts = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])) + 1
        edges = [0, *cuts.tolist(), len(c[0])]
        for a, b in zip(edges, edges[1:]):
            part = [x[a:b] for x in c]
            if held and (held[-1][0][0] != part[0][0] or held[-1][1][0] != part[1][0]):
                put([np.concatenate(x) for x in zip(*held)])
                held = []
            held.append([x.copy() for x in part])
        if len(out) >= 500:
            yield flush()
    if held:
        put([np.concatenate(x) for x in zip(*held)])
    yield flush()


def profiled(known: DataFrame, space: Workspace) -> DataFrame:
    """Profiles of the sets (doc, s1, n, set); a token's frequency is counted over all of them."""
    tokens = known.select("doc", "s1", "n", F.explode("set").alias("token"))
    often = space.staged(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "frequencies")
    told = spread_join(tokens, often.withColumn("times", F.col("often")), ["token"], ["doc"], n="times")
    ordered = told.select("doc", "s1", "n", "often", "token").repartition("doc", "s1").sortWithinPartitions("doc", "s1", "often", "token")
    return space.staged(ordered.mapInArrow(profiles, PROFILE_DDL), "profiles")


# ------------------------------------------------------- leaders and verification


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y, size and shared tokens of x, the same of y) that link."""
    for batch in batches:
        keep = []
        nx, ny = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 4))
        for i in np.flatnonzero(100 * np.minimum(nx, ny) >= SIMILAR * np.maximum(nx, ny)).tolist():
            a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (3, 5))
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= SIMILAR * (nx[i] + ny[i] - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["x", "y"])


def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (x, y) of ``pairs`` that link; ``known`` holds the profiles.  Any number of pairs may have one ``y``."""
    side = lambda p: known.select(F.col("doc").alias(p), F.col("n").alias("n" + p), F.col("tokens").alias("t" + p))
    counted = pairs.groupBy("y").agg(F.count("*").alias("n"))
    both = spread_join(pairs.join(side("x"), "x"), side("y"), ["y"], ["x"], counted, most=500)
    return both.select("x", "y", "nx", "tx", "ny", "ty").mapInArrow(verified, "x bigint, y bigint")


def met(posting: DataFrame) -> DataFrame:
    """Pairs (x, y): each document and, for each seed, the leader that it shares most prefix tokens with, if these
    are as many as the smaller ``k`` of both asks for.  ``posting`` has (token, doc, k)."""
    lead = [F.min_by(c, F.xxhash64("doc", F.lit(s))).alias(f"{c}{s}") for s in range(SEEDS) for c in ("doc", "k")]
    each = F.array(*(F.struct(F.lit(s).alias("seed"), F.col(f"doc{s}").alias("y"), F.col(f"k{s}").alias("ky")) for s in range(SEEDS)))
    leaders = posting.groupBy("token").agg(F.count("*").alias("n"), *lead).where("n > 1").select("token", "n", each.alias("leaders"))
    seen = spread_join(posting, leaders, ["token"], ["doc"]).select("doc", "k", F.explode("leaders").alias("l")).where("doc <> l.y")
    shared = seen.groupBy("doc", "l.seed", "l.y").agg(F.count("*").alias("c"), F.max("k").alias("k"), F.max("l.ky").alias("ky"))
    best = shared.where(F.col("c") >= F.least("k", "ky")).groupBy("doc", "seed").agg(F.max_by("y", "c").alias("y"))
    return best.select(F.col("doc").alias("x"), "y").distinct()


# ------------------------------------------------------------------- cells


def counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of ``a`` shares with each of ``b``; none has a token twice."""
    out = np.zeros((len(a), len(b)), np.float32)
    ta, tb = np.concatenate(a), np.concatenate(b)
    known = np.intersect1d(ta, tb)
    if not len(known):
        return out

    def placed(tokens: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        col = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        keep = np.flatnonzero(known[col] == tokens)
        keep = keep[np.argsort(col[keep], kind="stable")]
        return row[keep], col[keep]

    sides = [placed(ta, a), placed(tb, b)]
    for low in range(0, len(known), 4096):
        high = min(low + 4096, len(known))
        m = []
        for (row, col), parts in zip(sides, (a, b)):
            i, j = np.searchsorted(col, (low, high))
            x = np.zeros((len(parts), high - low), np.float32)
            x[row[i:j], col[i:j] - low] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def part_links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links between the parts of two blocks, as many as connect what is linked.

    Documents are (part, n, k, tokens).  A pair of unlike parts is a candidate
    if the sizes allow it and its prefixes for ``k`` matches, the smaller ``k``
    of both, share as many tokens; candidates are verified on all tokens.
    """
    (pl, nl, kl), (pr, nr, kr) = (np.array([x[:3] for x in side], np.int64).T for side in (left, right))
    small, large = np.minimum(nl[:, None], nr[None, :]), np.maximum(nl[:, None], nr[None, :])
    may = (pl[:, None] != pr[None, :]) & (100 * small >= SIMILAR * large)
    k = np.minimum(kl[:, None], kr[None, :])
    for level in np.unique(k[may]).tolist():
        rows, cols = (may & (k == level)).any(1).nonzero()[0], (may & (k == level)).any(0).nonzero()[0]
        cut = lambda side, at: [side[i][3][: len(side[i][3]) - overlap(side[i][1]) + level] for i in at.tolist()]  # noqa: B023, E731
        few = counts(cut(left, rows), cut(right, cols)) < level
        here = np.ix_(rows, cols)
        may[here] &= ~(few & (k[here] == level))
    rows, cols = may.any(1).nonzero()[0], may.any(0).nonzero()[0]
    if not len(rows):
        return []
    both = counts([left[i][3] for i in rows.tolist()], [right[j][3] for j in cols.tolist()]).astype(np.int64)
    hit = may[np.ix_(rows, cols)] & (100 * both >= SIMILAR * (nl[rows][:, None] + nr[cols][None, :] - both))
    i, j = hit.nonzero()
    if not len(i):
        return []
    pairs = np.unique(np.stack([pl[rows][i], pr[cols][j]], axis=1), axis=0)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    out = []
    for a, b in pairs.tolist():
        if (u := top(a)) != (v := top(b)):
            above[max(u, v)] = min(u, v)
            out.append((a, b))
    return out


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of parts (x, y) from rows (cell, bi, bj, side, part, n, k, tokens) that come in this order."""
    last, sides, out = None, ([], []), []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        side, part, n, k = (batch.column(c).to_pylist() for c in range(3, 7))
        for i, key in enumerate(keys):
            if key != last:
                if sides[0] and sides[1]:
                    out += part_links(*sides)
                last, sides = key, ([], [])
            sides[side[i]].append((part[i], n[i], k[i], np.frombuffer(batch.column(7)[i].as_py(), np.int64)))
    if sides[0] and sides[1]:
        out += part_links(*sides)
    c = list(zip(*out)) if out else ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["x", "y"])


def links_between(posting: DataFrame, known: DataFrame, part: DataFrame, space: Workspace) -> DataFrame:
    """Links (x, y) between parts of documents; ``part`` has (doc, part) of those that aren't alone.

    Tokens that several parts have in their prefixes are named after one of
    their documents, the one with the least hash, so that tokens which the same
    documents have become one cell and a pair meets once, not once for each
    token.  In a cell, all documents outside its largest part meet all
    documents, in blocks of bounded size.
    """
    own = space.staged(posting.join(part, "doc", "left").select("token", "doc", F.coalesce("part", "doc").alias("part")), "postings")
    named = own.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min_by("doc", F.xxhash64("doc")).alias("cell"), F.count("*").alias("n")).where("a < b").select("token", "cell", "n")
    placed = spread_join(own, named, ["token"], ["doc"]).select("cell", "doc", "part").distinct()
    cells = space.staged(placed.join(known.select("doc", F.octet_length("tokens").cast("long").alias("b")), "doc"), "cells")
    by_part = cells.groupBy("cell", "part").agg(F.count("*").alias("d"), F.sum("b").alias("b"))
    whole = by_part.groupBy("cell").agg(F.max(F.struct("d", "b", "part")).alias("m"), F.sum("d").alias("d"), F.sum("b").alias("b"))
    blocks = lambda d, b: F.greatest(F.ceil(d / CELL_DOCS), F.ceil(b / CELL_BYTES)).cast("int")
    plan = whole.select("cell", F.col("m.part").alias("most"), blocks(F.col("d") - F.col("m.d"), F.col("b") - F.col("m.b")).alias("ni"), blocks(F.col("d"), F.col("b")).alias("nj"), F.col("d").alias("n"))
    dealt = space.staged(spread_join(cells.drop("b"), plan, ["cell"], ["doc"]), "dealt")
    # a document of many cells, or of cells of many blocks, has its tokens copied by several tasks
    times = dealt.groupBy("doc").agg(F.sum(F.when(F.col("part") != F.col("most"), F.col("nj")).otherwise(0) + F.col("ni")).alias("times"))
    at = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("part <> most").select("cell", at("ni").alias("bi"), every("nj").alias("bj"), F.lit(0).alias("side"), "doc", "part")
    right = dealt.select("cell", every("ni").alias("bi"), at("nj").alias("bj"), F.lit(1).alias("side"), "doc", "part")
    rows = spread_join(left.unionAll(right), known.select("doc", "n", "k", "tokens"), ["doc"], ["cell", "bi", "bj"], times, "times", most=500).select("cell", "bi", "bj", "side", "part", "n", "k", "tokens")
    return rows.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj").mapInArrow(cell_links, "x bigint, y bigint")


# ---------------------------------------------------------------- the join


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``df``.

    Null and empty texts have no shingles and link with nothing.  Rows with one
    id are one node of the graph, which has the links of all their texts; each
    row comes back, also equal ones, with the size of its own set.  A null id
    links with nothing and has itself (null) as component.  Texts of any length
    are read whole.  Further columns are ignored; an empty table gives an empty
    one.
    """
    small_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc"), df[text_col].cast("string").alias("text"))
    here = docs.where("doc is not null")
    with Workspace(df.sparkSession, "jaccard") as space:
        first = space.staged(here.mapInArrow(screened, SCREEN_DDL), "screened")
        # one document stands for each class of equal sets, which has a row for each slice that holds it
        rows = first.where("doc is not null").select("doc", "n", "s1", "s2", "docs")
        classes = space.staged(rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")), "classes")
        placed = spread_join(rows.where("n > 0"), classes, ["n", "s1", "s2"], ["doc"], n="rows", most=500)
        empty = rows.where("n = 0").withColumn("rep", F.col("doc"))
        member = space.staged(placed.unionByName(empty), "members")
        left = survivors(first).join(member.where("n > 0 and doc = rep").select("doc", "s1"), ["doc", "s1"], "left_semi")
        left = space.staged(left, "survivors")
        few = left.count()
        chosen = F.broadcast(left) if few <= BROADCAST_IDS else left
        texts = here.join(F.broadcast(left.select("doc")) if few <= BROADCAST_IDS else left.select("doc"), "doc", "left_semi")
        full = texts.mapInArrow(full_sets, "doc bigint, s1 bigint, n int, set array<bigint>").join(chosen, ["doc", "s1"], "left_semi")
        known = space.staged(full, "sets")
        if known.count() > few:  # rows that repeat an id and its text
            known = space.staged(known.dropDuplicates(["doc", "s1"]), "sets")

        profile = profiled(known, space)
        posting = space.staged(profile.select(F.explode("prefix").alias("token"), "doc", "k"), "prefixes")
        near = verify(space.staged(met(posting), "pairs"), profile)
        part = space.staged(components(near, "x", "y", space).select(F.col("node").alias("doc"), F.col("component").alias("part")), "parts")
        between = space.staged(links_between(posting, profile, part, space), "between")
        # an id with several texts is in several classes
        each = member.where("n > 0").select("rep", F.explode("docs").alias("doc"))
        several = each.groupBy("doc").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
        several = several.select("doc").join(each, "doc").select(F.col("doc").alias("x"), F.col("rep").alias("y"))
        named = lambda c: several.join(part.select(F.col("doc").alias(c), "part"), c, "left").select(F.coalesce("part", c).alias("p"), *(o for o in "xy" if o != c))
        joined = named("x").withColumnRenamed("p", "x").join(part.withColumnRenamed("doc", "y"), "y", "left").select("x", F.coalesce("part", "y").alias("y"))
        whole = components(between.unionAll(joined), "x", "y", space).select(F.col("node").alias("part"), "component")

        placed = member.join(part.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("part", F.coalesce("part", "rep")).join(whole, "part", "left")
        out = placed.select(F.explode("docs").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "part").alias("c"))
        out = out.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col(id_col)).alias("component_id"))
        result = staged(out, "jaccard-result")
    nameless = docs.where("doc is null").mapInArrow(full_sets, "doc bigint, s1 bigint, n int, set array<bigint>").select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionAll(nameless)
