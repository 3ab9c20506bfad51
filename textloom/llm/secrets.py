"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text by three fixed patterns.  The hash of
each candidate's value is then counted over the corpus by distinct owners and
repositories: a value that several owners carry is a copied example, a value
that one owner has to itself and that looks random is a live credential.

DataFrame functions only.  Values never leave the scan, only their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.util import spread_join, staged

# What counts as a candidate.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex")

#: Distinct owners from which a value counts as a copied example; repositories from which one of two owners does.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: Length and distinct characters from which a value looks live.
LIVE_LENGTH, LIVE_DISTINCT = 12, 8
#: Words of made-up values in documentation.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]?|xxxx|\*\*\*\*|redacted"


def _joined(spans: Column, names: Column) -> Column:
    """Spans as text, equal ones once."""
    told = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.array_distinct(told), ",")


MATCHES = "array<struct<gap:int,length:int,kept:boolean,before:int,value_hash:string,live:boolean>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """What a pattern finds, in order: characters since the match before, length, whether it is a candidate, characters
    before its value, and the value's hash and look.  The text between matches gives their places in one pass."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("gap"))

    def told(x: Column) -> Column:
        value = F.regexp_extract(x["m"], pattern, 1) if kind == 0 else x["m"]
        n = F.length(x["m"])
        kept = F.length(value) >= LEAST_VALUE if kind == 0 else F.lit(True)
        return F.struct(F.length(x["gap"]).alias("gap"), n.alias("length"), kept.alias("kept"), (n - F.length(value)).alias("before"), F.sha2(value, 256).alias("value_hash"), looks_live(value).alias("live"))

    return F.transform(F.filter(found, lambda x: x["m"].isNotNull()), told)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``matches``: for each of KINDS its matches (MATCHES) in order; null if there are none at all.

    Null and empty texts have none.  Assignments whose value is shorter than six
    characters are matches but no candidates, since they still consume their
    characters.  What can't match is told by a plain search first.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX)
    may = (t.rlike(ASSIGN), t.contains("AKIA"), t.rlike(HEX))
    none = F.array().cast(MATCHES)
    found = F.array(*(F.when(m, _matches(t, p, k)).otherwise(none) for k, (m, p) in enumerate(zip(may, patterns))))
    return df.withColumn("matches", F.when(may[0] | may[1] | may[2], found))


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (distinct >= LIVE_DISTINCT) & ~value.rlike(PLACEHOLDER)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash → owners, repositories, uses, class, from rows (value_hash, live, owner, repository).

    Class: ``example`` (EXAMPLE_OWNERS owners or more, or two of them in
    EXAMPLE_REPOSITORIES repositories or more), ``live`` (one owner, however many
    of its repositories, and live-looking), ``review`` (the rest).  Counted in steps that each merge
    before they shuffle, so that a value in a third of all rows makes no hot task.
    """
    by_repo = candidates.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("uses"), F.max("live").alias("live"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"), F.max("live").alias("live"))
    by_value = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"), F.max("live").alias("live"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") == 2) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    kind = F.when(copied, "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("review")
    return by_value.withColumn("class", kind)


def owned_secrets(df: DataFrame, owner: Column, repository: Column, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``secrets``: its candidates, each with owners, repositories, uses and class.

    Every row of ``df`` comes back once, also equal rows, null texts and rows
    without candidates (empty array).  Null owners and repositories count as
    one owner and one repository each.  Texts of any length are scanned whole.
    Columns of ``df`` named ``secrets`` or ``matches`` are replaced.  Without
    ``keep_text`` the texts are left out as soon as they are scanned.  Only rows
    with matches take part in joins.
    """
    few = df.drop("secrets", "matches")
    found = scan(few.withColumns({"__owner": F.coalesce(owner.cast("string"), F.lit("")), "__repository": F.coalesce(repository.cast("string"), F.lit(""))}), text)
    if not keep_text:
        found = found.drop(text)
    rows = staged(found.withColumn("__row", F.monotonically_increasing_id()), "secrets")
    some = rows.where("matches is not null")
    each = some.select("__row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"), F.posexplode("matches").alias("kind", "m"))
    each = each.select("__row", "owner", "repository", "kind", F.posexplode("m").alias("place", "m")).select("__row", "owner", "repository", "kind", "place", "m.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("__row", "kind").orderBy("place"))
    flat = each.withColumn("end", end.cast("int")).where("kept").withColumn("start", F.col("end") - F.col("length"))
    flat = flat.select("__row", "owner", "repository", "kind", "start", "end", (F.col("start") + F.col("before")).alias("value_start"), "value_hash", "live")
    counts = ownership(flat.select("value_hash", "live", "owner", "repository")).select("value_hash", "owners", "repositories", "uses", "class")
    told = spread_join(flat, counts.withColumn("n", F.col("uses")), ["value_hash"], ["__row", "start"])
    told = told.select("__row", F.struct("start", "kind", "end", "value_start", "owners", "repositories", "uses", "class", "value_hash").alias("s"))
    per_row = told.groupBy("__row").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    none = F.array().cast(per_row.schema["secrets"].dataType)
    helpers = ("__row", "__owner", "__repository", "matches")
    hit = some.join(per_row, "__row", "left").withColumn("secrets", F.coalesce("secrets", none)).drop(*helpers)
    return hit.unionByName(rows.where("matches is null").withColumn("secrets", none).drop(*helpers))


def digest(df: DataFrame) -> DataFrame:
    """``secrets`` as counts, base_sha256 and spans.

    Spans added to the base ones: ``live`` and ``example``, over the value of a
    candidate of that class.
    """
    names = F.array(*[F.lit(k) for k in (*KINDS, "live", "example")])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    plain = lambda s, kind, start: F.struct(start.alias("start"), kind.alias("kind"), s["end"].alias("end"))
    base = F.transform("secrets", lambda s: plain(s, s["kind"], s["start"]))
    more = F.transform(F.filter("secrets", lambda s: s["class"].isin("live", "example")), lambda s: plain(s, F.when(s["class"] == "live", 3).otherwise(4), s["value_start"]))
    return df.withColumns(
        {
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "base_sha256": F.sha2(_joined(base, names), 256),
            "spans": _joined(F.array_sort(F.concat(base, more)), names),
        }
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts in which the values of all secrets but copied examples are replaced by ``[SECRET]``.

    Overlapping spans are merged by going on from the furthest end.  Null texts stay null.
    """

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(x["value_start"], s["pos"])
        piece = F.substring(F.col(text), s["pos"] + 1, start - s["pos"])
        fresh = x["end"] > s["pos"]
        mark = F.when(x["value_start"] >= s["pos"], F.lit("[SECRET]")).otherwise(F.lit(""))
        return F.struct(F.greatest(x["end"], s["pos"]).alias("pos"), F.when(fresh, F.concat(s["out"], piece, mark)).otherwise(s["out"]).alias("out"))

    hidden = F.array_sort(F.transform(F.filter("secrets", lambda s: s["class"] != "example"), lambda s: F.struct(s["value_start"].alias("value_start"), s["end"].alias("end"))))
    done = F.aggregate(hidden, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["pos"] + 1, F.length(text))))
    return df.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(F.col(text)))
