"""Reads over metadata: vaults, files, conversations, runs, profiles, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.paths import contains_ignoring_case, file_status
from textloom.functions.text import derive_title, mask_key

ACTIVE = ("queued", "running", "cancelling")
TERMINAL = ("success", "partial", "failed", "cancelled", "aborted")


class Tenant:
    """Tables as one user sees them: every read is filtered by the owner."""

    def __init__(self, user_id: str, **tables: DataFrame):
        self._user, self._tables = user_id, tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self._tables[name].where(F.col("user_id") == self._user)


def only(df: DataFrame, where: Column) -> DataFrame:
    """The row that a unique lookup names; two rows are an error when it runs."""
    two = df.where(where).limit(2)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # two rows at most
    return two.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row")).cast("boolean")).otherwise(True)).drop("__n")


def scope_counts(vaults: DataFrame, notes: DataFrame, chunks: DataFrame, vault: str = "vault_id") -> DataFrame:
    """Notes and chunks of every vault, zero where there are none."""
    n = notes.groupBy(vault).agg(F.count("*").alias("n"))
    c = chunks.groupBy(vault).agg(F.count("*").alias("c"))
    joined = vaults.join(n, vault, "left").join(c, vault, "left")
    return joined.withColumns({"note_count": F.coalesce("n", F.lit(0)), "chunk_count": F.coalesce("c", F.lit(0))}).drop("n", "c")


def file_states(files: DataFrame, notes: DataFrame, failed: DataFrame, current: Column) -> DataFrame:
    """Files (rel_path, ...) with their status; ``failed`` has the paths that failed last."""
    known = notes.select(F.col("file_path").alias("rel_path"), F.lit(True).alias("__note")).distinct()
    bad = failed.select("rel_path", F.lit(True).alias("__bad")).distinct()
    joined = files.join(known, "rel_path", "left").join(bad, "rel_path", "left")
    return joined.withColumn("status", file_status(F.col("rel_path") == current, F.col("__bad"), F.col("__note"))).drop("__note", "__bad")


def status_counts(states: DataFrame) -> DataFrame:
    """One row with a count of each state, over all files."""
    return states.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("indexing", "error", "indexed", "pending")), F.count("*").alias("total"))


def file_page(states: DataFrame, page: int, size: int, status: str | None = None, search: str | None = None) -> DataFrame:
    """One page of files by path without regard to case."""
    if not 1 <= size <= 100 or page < 1:
        raise ValueError("page is from 1 and size from 1 to 100")
    rows = states
    if status:
        rows = rows.where(F.col("status") == status)
    if search:
        rows = rows.where(contains_ignoring_case(F.col("rel_path"), search))
    return rows.orderBy(F.lower("rel_path"), "rel_path").offset((page - 1) * size).limit(size)


def browse(files: DataFrame, parent: str = "") -> DataFrame:
    """Folders right below ``parent``: name and whether they have folders themselves; hidden ones are left out."""
    if ".." in parent.split("/"):
        raise ValueError("the folder is outside the root")
    depth = len([p for p in parent.split("/") if p])
    below = files.where(F.col("rel_path").startswith(parent.rstrip("/") + "/")) if depth else files
    parts = below.select(F.split("rel_path", "/").alias("p")).where(F.size("p") > depth + 1)
    named = parts.select(F.col("p")[depth].alias("name"), (F.size("p") > depth + 2).alias("deep")).where(~F.col("name").startswith("."))
    return named.groupBy("name").agg(F.max("deep").alias("has_children")).orderBy("name")


# ---------------------------------------------------------- conversations


def conversation_list(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Each conversation's number of messages and its title, from the first message of the user; one pass."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(content)), F.when(F.col(role) == "user", F.col(order)))
    grouped = messages.groupBy(conversation).agg(F.count("*").alias("message_count"), first.alias("first_message"))
    return grouped.withColumn("title", derive_title(F.col("first_message")))


# ------------------------------------------------------------------- runs


def retained(runs: DataFrame, vault: str, run: str, status: str, started: str, keep: int = 50) -> DataFrame:
    """The newest ``keep`` runs of each vault and all that are active."""
    newest = Window.partitionBy(vault).orderBy(F.desc(started), F.desc(run))
    return runs.withColumn("__r", F.row_number().over(newest)).where((F.col("__r") <= keep) | F.col(status).isin(*ACTIVE)).drop("__r")


def recovered(runs: DataFrame, status: str = "status") -> DataFrame:
    """After a crash what was queued or running is aborted."""
    return runs.withColumn(status, F.when(F.col(status).isin("queued", "running"), "aborted").otherwise(F.col(status)))


def latest_active(runs: DataFrame, vault: str, run: str, status: str, started: str) -> DataFrame:
    """The newest active run of each vault."""
    active = runs.where(F.col(status).isin(*ACTIVE))
    best = active.groupBy(vault).agg(F.max(F.struct(F.col(started).alias("t"), F.col(run).alias("r"))).alias("m"))
    return best.select(vault, F.col("m.r").alias(run), F.col("m.t").alias(started))


def kpis(runs: DataFrame, status: str, started: str, day: Column) -> DataFrame:
    """One row: running, queued, and what succeeded or failed on a day."""
    today = F.to_date(started) == day
    n = F.count_if
    return runs.agg(n(F.col(status) == "running").alias("running"), n(F.col(status) == "queued").alias("queued"), n(today & (F.col(status) == "success")).alias("success_today"), n(today & (F.col(status) == "failed")).alias("failed_today"))


def latest_state(events: DataFrame, run: str, at: str, columns: list[str]) -> DataFrame:
    """State of each run from a log of changes: for each column its newest value that is not null."""
    return events.groupBy(run).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns))


def run_detail(runs: DataFrame) -> DataFrame:
    """Runs with ``plan`` for finished dry runs and ``result`` for finished real ones."""
    counts = F.struct("adds", "updates", "moves", "deletes", "unchanged", "failed_cnt", "blocked_reason")
    over = F.col("status").isin(*TERMINAL)
    prune_blocked = F.coalesce(F.col("blocked_reason").isin("over_ratio", "prune_disabled"), F.lit(False))
    return runs.withColumns({"plan": F.when(over & F.col("dry_run"), counts), "result": F.when(over & ~F.col("dry_run"), counts), "prune_blocked": prune_blocked, "cancelling": F.col("cancel_requested") & ~over})


def newest(rows: DataFrame, by: list[str], limit: int, most: int = 200) -> DataFrame:
    """The newest rows first; ``limit`` is from 1 to ``most`` (lists of conversations ask for 50, of runs for 20)."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit is from 1 to {most}")
    return rows.orderBy(*[F.desc(c) for c in by]).limit(limit)


def run_table(runs: DataFrame, status: str = "status", started: str = "started_at", run: str = "run_id", only_status: str | None = None, since: Column | None = None) -> DataFrame:
    """Runs with their place in the task list: active ones first, then the newest; by status and from a time on."""
    rows = runs.where(F.col(status) == only_status) if only_status else runs
    rows = rows.where(F.col(started) >= since) if since is not None else rows
    return rows.withColumn("active", F.col(status).isin(*ACTIVE)).orderBy(F.desc("active"), F.desc(started), F.desc(run))


def global_counts(vaults: DataFrame, profiles: DataFrame) -> DataFrame:
    """kind and n: vaults, and profiles of each kind."""
    return vaults.agg(F.count("*").alias("n")).select(F.lit("vaults").alias("kind"), "n").unionByName(profiles.groupBy("kind").agg(F.count("*").alias("n")))


def embed_profile(explicit: Column, vault: Column) -> Column:
    """Which profile embeds: the one asked for, else the vault's, else the one of the environment."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(vault, F.lit("")), F.lit("env"))


def writes_back(status: Column, dry_run: Column) -> Column:
    """Whether a run's end changes its vault's embedding state."""
    return status.isin("success", "partial") & ~dry_run


# --------------------------------------------------------------- profiles


def resolve_profile(profiles: DataFrame, ref: str | None) -> DataFrame:
    """The profile that a reference means: by id or name, else the default, else the first enabled.  A
    reference that is given must match."""
    p = profiles.where("enabled")
    if ref:
        named = (F.col("id") == int(ref)) if ref.isdigit() else (F.col("name") == ref)
        return p.where(named).orderBy("id").limit(1)
    return p.orderBy(F.desc("is_default"), "id").limit(1)


def default_profiles(profiles: DataFrame) -> DataFrame:
    """For each user and kind the default profile, or the first enabled one."""
    best = Window.partitionBy("user_id", "kind").orderBy(F.desc("is_default"), "id")
    return profiles.where("enabled").withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def image_profiles(profiles: DataFrame) -> DataFrame:
    """For each user the language model that reads images, the default before others."""
    able = F.coalesce(F.try_element_at("params", F.lit("multimodal")) == "true", F.lit(False))
    best = Window.partitionBy("user_id").orderBy(F.desc("is_default"), "id")
    return profiles.where((F.col("kind") == "llm") & F.col("enabled") & able).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def set_default(profiles: DataFrame, profile_id: int) -> DataFrame:
    """The profile becomes the only default of its user and kind."""
    chosen = profiles.where(F.col("id") == profile_id).select(F.col("user_id").alias("u"), F.col("kind").alias("k"))
    same = (F.col("user_id") == F.col("u")) & (F.col("kind") == F.col("k"))
    joined = profiles.join(F.broadcast(chosen), same, "left")  # one row
    return joined.withColumn("is_default", F.when(F.col("u").isNotNull(), F.col("id") == profile_id).otherwise(F.col("is_default"))).drop("u", "k")


def public_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("api_key", mask_key(F.col("api_key")))


def used_profiles(profiles: DataFrame, vaults: DataFrame) -> DataFrame:
    """Profiles that a vault uses or was ever indexed with."""
    used = vaults.select(F.explode(F.array_union(F.coalesce("embed_indexed_profiles", F.array().cast("array<int>")), F.array("embed_profile_id"))).alias("id")).where("id is not null").select(F.col("id").cast("long").alias("id")).distinct()
    return profiles.join(used, "id", "left_semi")


def searchable(vaults: DataFrame, user_id: str) -> DataFrame:
    """A user's vaults that have an index under a profile."""
    return vaults.where((F.col("user_id") == user_id) & F.col("indexed_at").isNotNull() & F.col("embed_profile_id").isNotNull())


def compatible(vaults: DataFrame, profile_id: int) -> DataFrame:
    """Vaults with whether they can be searched under a profile."""
    return vaults.withColumn("compatible", F.coalesce(F.array_contains("embed_indexed_profiles", profile_id), F.lit(False)))


def active_keys(keys: DataFrame) -> DataFrame:
    return keys.where(F.col("revoked_at").isNull()).orderBy(F.desc("id"))


#: Steps that end a run, each the status that it leaves.
ENDS = ("success", "partial", "failed", "cancelled", "aborted")


def guarded_steps(log: DataFrame, run: str, order: list[str], step: str) -> DataFrame:
    """``log`` with ``accepted``: whether each step was allowed in the state that its run was in.

    Steps are create, start, progress, cancel and those of ENDS, taken in the
    order of the columns ``order``, which must tell them apart.  Only the first
    create makes a run, and nothing counts before it; a start counts once, as
    long as the run is queued; a cancel until the run ends; progress and ends
    always.  Null runs and unknown or null steps are rejected.  A run may have
    any number of steps: first places are aggregated, no run's log is gathered.
    """
    place = F.struct(*order)
    is_end = F.col(step).isin(*ENDS)
    made = log.where(F.col(step) == "create").groupBy(run).agg(F.min(place).alias("__made"))
    later = log.where(is_end | (F.col(step) == "start")).join(made, run).where(place > F.col("__made"))
    first = later.groupBy(run).agg(F.min(F.when(is_end, place)).alias("__ended"), F.min(F.when(F.col(step) == "start", place)).alias("__started"))
    known = log.join(made.join(first, run, "left"), run, "left")
    after = place > F.col("__made")
    going = F.col("__ended").isNull() | (place < F.col("__ended"))
    allowed = F.when(F.col(step) == "create", place == F.col("__made")).when(F.col(step) == "start", (place == F.col("__started")) & going).when(F.col(step) == "cancel", after & going).when(is_end | (F.col(step) == "progress"), after)
    return known.withColumn("accepted", F.coalesce(allowed, F.lit(False))).drop("__made", "__ended", "__started")


def states_of_steps(steps: DataFrame, run: str, order: list[str], step: str, at: str) -> DataFrame:
    """run, status, started_at, finished_at, elapsed_ms and cancel_requested from accepted steps; the last end counts.

    A run starts with its creation, as its time in the queue is part of it.
    """
    place, is_end = F.struct(*order), F.col(step).isin(*ENDS)
    one = steps.where("accepted").groupBy(run).agg(
        F.max_by(F.when(is_end, F.col(step)), F.when(is_end, place)).alias("ended"),
        F.max(F.col(step) == "start").alias("begun"),
        F.min(F.when(F.col(step) == "create", F.col(at))).alias("started_at"),
        F.max_by(F.when(is_end, F.col(at)), F.when(is_end, place)).alias("finished_at"),
        F.max(F.col(step) == "cancel").alias("cancel_requested"),
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    elapsed = F.floor((micros("finished_at") - micros("started_at")) / 1000)
    return one.select(run, F.coalesce("ended", F.when(F.col("begun"), "running").otherwise("queued")).alias("status"), "started_at", "finished_at", F.coalesce(elapsed, F.lit(0)).cast("long").alias("elapsed_ms"), "cancel_requested")
