"""Reconciliation of a file snapshot with what is indexed, and index checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.5


def need_hash(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content must be hashed: new ones, and those of another size or time."""
    old = known.select("rel_path", F.col("size_bytes").alias("s"), F.col("mtime_ns").alias("m"))
    joined = seen.join(old, "rel_path", "left")
    return joined.where(F.col("s").isNull() | (F.col("s") != F.col("size_bytes")) | (F.col("m") != F.col("mtime_ns"))).drop("s", "m")


def classify(seen: DataFrame, known: DataFrame) -> DataFrame:
    """rel_path, action (add, delete, update, unchanged) and content_hash of the side that has it.

    Same size and time is unchanged, and so is the same content.
    """
    a = seen.select("rel_path", *(F.col(c).alias(f"{c}_s") for c in ("size_bytes", "mtime_ns", "content_hash")), F.lit(True).alias("in_s"))
    b = known.select("rel_path", *(F.col(c).alias(f"{c}_k") for c in ("size_bytes", "mtime_ns", "content_hash")), F.lit(True).alias("in_k"))
    hash_ = lambda c: F.when(F.col(c) != "", F.col(c))
    same = ((F.col("size_bytes_s") == F.col("size_bytes_k")) & (F.col("mtime_ns_s") == F.col("mtime_ns_k"))) | (hash_("content_hash_s") == hash_("content_hash_k"))
    action = F.when(F.col("in_k").isNull(), "add").when(F.col("in_s").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("update")
    return a.join(b, "rel_path", "full_outer").select("rel_path", action.alias("action"), F.coalesce(hash_("content_hash_s"), hash_("content_hash_k")).alias("content_hash"))


def moves(classified: DataFrame) -> DataFrame:
    """old_path and new_path: content that went once and came once."""
    side = lambda action, name: classified.where((F.col("action") == action) & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("rel_path").alias(name)).where("n = 1").drop("n")
    return side("delete", "old_path").join(side("add", "new_path"), "content_hash").select("old_path", "new_path")


def plan(seen: DataFrame, known: DataFrame) -> DataFrame:
    """action, old_path and new_path of every file: adds, updates, deletes, moves and unchanged."""
    c = classify(seen, known)
    m = moves(c)
    rest = c.join(m.select(F.col("old_path").alias("rel_path"), F.lit("delete").alias("action")).unionByName(m.select(F.col("new_path").alias("rel_path"), F.lit("add").alias("action"))), ["rel_path", "action"], "left_anti")
    old = F.when(F.col("action") != "add", F.col("rel_path"))
    new = F.when(F.col("action") != "delete", F.col("rel_path"))
    return rest.select("action", old.alias("old_path"), new.alias("new_path")).unionByName(m.select(F.lit("move").alias("action"), "old_path", "new_path"))


def blocked(known: Column, deletes: Column, force: Column, prune: Column, scan_complete: Column, ratio: float = RATIO, available: Column | None = None) -> Column:
    """Why deletions are held back, or null: no source, pruning off, an incomplete scan, too large a share of what is
    known; the first of these."""
    over = ~force & (known > 0) & (deletes / F.when(known > 0, known) > ratio)
    gone = F.lit(False) if available is None else ~available
    return F.when(gone, "source_unavailable").when(~prune, "prune_disabled").when(~scan_complete, "scan_incomplete").when(F.coalesce(over, F.lit(False)), "over_ratio")


def summary(planned: DataFrame, known_count: int | None = None, force: bool = False, prune: bool = True, scan_complete: bool = True, ratio: float = RATIO) -> DataFrame:
    """One row: a count of each action and the guard's verdict.

    All files that are known have some action other than add, so that their
    number follows from the plan.
    """
    n = lambda a: F.count_if(F.col("action") == a)
    counted = planned.agg(n("add").alias("adds"), n("update").alias("updates"), n("move").alias("moves"), n("delete").alias("deletes"), n("unchanged").alias("unchanged"))
    known = F.lit(known_count) if known_count is not None else F.col("updates") + F.col("moves") + F.col("deletes") + F.col("unchanged")
    return counted.withColumn("blocked_reason", blocked(known, F.col("deletes"), F.lit(force), F.lit(prune), F.lit(scan_complete), ratio))


ORDER = ("move", "add", "update", "delete")


def apply_plan(planned: DataFrame, failed: DataFrame, held_back: Column) -> DataFrame:
    """A plan as it is carried out: step, action, paths and outcome (done, failed, blocked) of every file but unchanged ones.

    Moves come first, then adds and updates, then deletes; a file in ``failed``
    (rel_path) is recorded and the run goes on; deletes that the guard
    ``held_back`` are blocked.
    """
    bad = failed.select(F.col("rel_path").alias("__path"), F.lit(True).alias("__bad")).distinct()
    step = F.when(F.col("action") == "move", 1).when(F.col("action") == "delete", 3).otherwise(2)
    joined = planned.where(F.col("action").isin(*ORDER)).withColumn("__path", F.coalesce("new_path", "old_path")).join(bad, "__path", "left")
    outcome = F.when((F.col("action") == "delete") & held_back, "blocked").when(F.col("__bad"), "failed").otherwise("done")
    return joined.select(step.alias("step"), "action", "old_path", "new_path", outcome.alias("outcome"))


def applied_notes(notes: DataFrame, done: DataFrame, seen: DataFrame) -> DataFrame:
    """Signatures (rel_path, size_bytes, mtime_ns, content_hash) of the index after a plan: only what was done counts."""
    ok = done.where("outcome = 'done'")
    columns = ("rel_path", "size_bytes", "mtime_ns", "content_hash")
    moved = ok.where("action = 'move'").select(F.col("old_path").alias("rel_path"), "new_path")
    kept = notes.select(*columns).join(ok.where("action in ('update', 'delete')").select(F.col("old_path").alias("rel_path")), "rel_path", "left_anti")
    kept = kept.join(moved, "rel_path", "left").withColumn("rel_path", F.coalesce("new_path", "rel_path")).select(*columns)
    fresh = seen.select(*columns).join(ok.where("action in ('add', 'update')").select(F.col("new_path").alias("rel_path")), "rel_path", "left_semi")
    return kept.unionByName(fresh)


SAMPLES = 10


def samples(planned: DataFrame, n: int = SAMPLES) -> DataFrame:
    """action and its first paths in order; unchanged files have none.  No action's paths are gathered whole."""
    path = F.coalesce("new_path", "old_path")
    ranked = planned.where("action <> 'unchanged'").select("action", path.alias("path"))
    kept = ranked.withColumn("r", F.row_number().over(Window.partitionBy("action").orderBy("path"))).where(F.col("r") <= n)
    return kept.groupBy("action").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def run_status(cancelled: Column, source_failed: Column, failed: Column) -> Column:
    return F.when(cancelled, "cancelled").when(source_failed, "failed").when(failed > 0, "partial").otherwise("success")


# ------------------------------------------------------------ consistency


def ghosts(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors without a chunk."""
    return vectors.join(chunks.select("vector_id"), "vector_id", "left_anti")


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors.select("vector_id"), "vector_id", "left_anti")


def orphans(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes without a chunk."""
    return notes.join(chunks.select(F.col("note_id").alias("id")), "id", "left_anti")


def model_mismatch(chunks: DataFrame, vaults: DataFrame) -> DataFrame:
    """Chunks embedded under another profile than their vault's."""
    v = vaults.select(F.col("id").alias("vault_id"), F.col("embed_profile_id").alias("wanted"))
    return chunks.join(v, "vault_id").where(~F.col("embed_profile_id").eqNullSafe(F.col("wanted"))).drop("wanted")


def doctor(vectors: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: how many ghosts, missing vectors and orphans there are, and whether the index is sound."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(ghosts(vectors, chunks), "ghosts").crossJoin(count(missing(chunks, vectors), "missing")).crossJoin(count(orphans(notes, chunks), "orphans"))
    return row.withColumn("healthy", (F.col("ghosts") + F.col("missing") + F.col("orphans")) == 0)


def repair(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors without the ghosts; nothing else is changed."""
    return vectors.join(chunks.select("vector_id"), "vector_id", "left_semi")
