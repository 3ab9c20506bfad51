"""Paths, globs and file states."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scan takes and leaves unless told otherwise.
EXTENSIONS = ("md", "txt", "docx", "pdf", "xlsx")
MAX_BYTES = 10 * 1024 * 1024
FORMATS = {".md": "markdown", ".markdown": "markdown", ".docx": "markdown", ".pdf": "markdown", ".xlsx": "markdown", ".xlsm": "markdown", ".html": "html", ".htm": "html"}


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole paths; ``*`` crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))
            if end < 0:
                out += r"\["
            else:
                inner = pattern[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"\&\&")
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else ("\\" + inner if inner[0] == "^" else inner)) + "]"
                i = end + 1
        else:
            out += re.sub(r"([\\.^$|()+{}\]])", r"\\\1", c)
    return f"(?s)^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def excluded_prefixes(patterns: list[str]) -> list[str]:
    """Subtrees that exclude patterns name whole (``dir/**`` or ``dir/``), which a scan need not enter."""
    out = []
    for p in patterns:
        p = p.removeprefix("./")
        p = p.removesuffix("/**") if p.endswith("/**") else p.removesuffix("/") if p.endswith("/") else ""
        if p and not re.search(r"[*?\[]", p):
            out.append(p)
    return sorted(set(out))


def norm_extension(c: Column) -> Column:
    bare = F.ltrim(F.lower(F.trim(c)), F.lit("."))
    return F.when(bare != "", F.concat(F.lit("."), bare))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def chunk_format(path: Column) -> Column:
    """How a file's text is cut: markdown, html or text."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text"))


def wanted(path: Column, size: Column, include: list[str] | None = None, exclude: list[str] | None = None, exts: list[str] | None = None, max_size: int | None = None) -> Column:
    """Whether a scan keeps a file: extension, then include, then exclude, then size."""
    exts = [e.strip().lower().lstrip(".") for e in (EXTENSIONS if exts is None else exts)]
    keep = extension(path).isin(*["." + e for e in exts if e])
    if include:
        keep = keep & matches_any(path, include)
    if exclude:
        keep = keep & ~matches_any(path, exclude)
        for p in excluded_prefixes(exclude):
            keep = keep & ~path.startswith(p + "/")
    return keep & (size <= (MAX_BYTES if max_size is None else max_size))


def normalize_path(c: Column) -> Column:
    """A relative path with ``/`` and without empty and ``.`` parts; null if it climbs with ``..``."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def contains_ignoring_case(path: Column, needle: str) -> Column:
    return F.lower(path).contains(needle.lower())


def parse_source(c: Column) -> Column:
    """(type, value) of ``type:value``; Windows drives and bare paths are local."""
    kind = F.lower(F.regexp_extract(c, r"(?i)^(local|uploaded|git|remote):", 1))
    value = F.regexp_replace(c, r"(?i)^(local|uploaded|git|remote):", "")
    return F.struct(F.when(kind != "", kind).otherwise("local").alias("type"), F.trim(value).alias("value"))


def source_order(vault_id: Column, sources: Column, path: Column) -> Column:
    """What a request searches or reads: its vault, else its list of sources, else its path, each as (type, value)."""
    one = lambda c: F.array(c)
    vault = F.struct(F.lit("vault").alias("type"), vault_id.cast("string").alias("value"))
    return F.when(vault_id.isNotNull(), one(vault)).when(F.size(F.coalesce(sources, F.array().cast("array<string>"))) > 0, F.transform(sources, parse_source)).when(path.isNotNull(), one(parse_source(path))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))


def vault_name(value: Column) -> Column:
    """A vault's name: the last part of its path."""
    return F.element_at(F.split(F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)


def filter_precedence(request: Column, vault: Column, settings: Column) -> Column:
    """The list that a scan filters by: the request's, else the vault's, else the settings'; an empty one is none."""
    given = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(given(request), given(vault), settings)


def file_status(is_current: Column, failed: Column, has_note: Column) -> Column:
    """State of a file: indexing before error before indexed before pending."""
    return F.when(F.coalesce(is_current, F.lit(False)), "indexing").when(F.coalesce(failed, F.lit(False)), "error").when(F.coalesce(has_note, F.lit(False)), "indexed").otherwise("pending")


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))
    return (
        F.when(then.isNull(), "")
        .when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
    )


def percent(done: Column, total: Column) -> Column:
    """Progress in whole hundredths, 100 at most; null without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.round(done * 100 / total).cast("int")))
