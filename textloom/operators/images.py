"""Images that notes refer to: which file is meant, and what a description needs to know of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from textloom.functions.text import data_url, strip
from textloom.sources.parsers import IMAGE_BYTES, IMAGE_SIDE, image_size

# Folders in which wiki links are looked for, and extensions that a target may leave out, in order.
ATTACHMENT_FOLDERS = ("attachments", "assets", "images", "img", "media", "files")
EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")


def collapsed(path: Column) -> Column:
    """A relative path without empty, ``.`` and ``..`` parts; null if it is absolute or climbs out of its root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        parts = F.when(up, F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0)))).when((p == "") | (p == "."), s["parts"]).otherwise(F.concat(s["parts"], F.array(p)))
        return F.struct(parts.alias("parts"), (s["out"] | (up & (F.size(s["parts"]) == 0))).alias("out"))

    end = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~end["out"] & ~path.startswith("/"), F.array_join(end["parts"], "/"))


def folder(path: Column) -> Column:
    """The folder of a relative path; empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def root_of(absolute: Column, relative: Column) -> Column:
    """The root folder from a file's absolute path and its path below the root."""
    parts = F.filter(F.split(F.replace(relative, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    of = F.split(absolute, "/")
    return F.array_join(F.slice(of, F.lit(1), F.greatest(F.size(of) - F.size(parts), F.lit(0))), "/")


def candidates(note: Column, target: Column, kind: Column) -> Column:
    """Paths below the root that a target may mean, the first choice first.

    The note's folder comes first, for wiki links the root and its attachment
    folders follow; in each the target as it stands, then with ``%20`` and the
    like decoded; a name without extension is tried bare, then with each known
    one.  Paths that leave the root are left out.  A target with a broken escape
    is not decoded.
    """
    bases = F.when(kind == "wiki", F.array(folder(note), F.lit(""), *map(F.lit, ATTACHMENT_FOLDERS))).otherwise(F.array(folder(note)))
    decoded = F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))
    names = F.array_distinct(F.array(target, F.coalesce(decoded, target)))
    suffixed = lambda n: F.when(F.rtrim(n, F.lit("/")).rlike(r"[^/]\.[^./]+$"), F.array(n)).otherwise(F.array(n, *(F.concat(F.rtrim(n, F.lit("/")), F.lit(e)) for e in EXTENSIONS)))
    below = lambda b, n: F.when((b == "") | n.startswith("/"), n).otherwise(F.concat(b, F.lit("/"), n))
    every = F.flatten(F.transform(bases, lambda b: F.flatten(F.transform(names, lambda n: F.transform(suffixed(n), lambda v: collapsed(below(b, v)))))))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != "")))


def resolve(refs: DataFrame, files: DataFrame, vault: str = "vault", note: str = "note", target: str = "target", kind: str = "kind", path: str = "path") -> DataFrame:
    """``refs`` with ``resolved``, the path of the file that is meant; null if there is none.

    ``files`` has (vault, path) of what there is; repeated rows count once.  A
    target is resolved once for each folder that refers to it.  Every row of
    ``refs`` comes back once; nulls in its columns resolve to nothing.
    """
    keys = {"__vault": F.col(vault), "__folder": folder(F.col(note)), "__target": strip(F.col(target)), "__wiki": F.col(kind) == "wiki"}
    keyed = refs.withColumns(keys)
    asked = keyed.where("__target <> '' and __folder is not null and __vault is not null and __wiki is not null").select(*keys).distinct()
    options = candidates(F.concat("__folder", F.lit("/")), F.col("__target"), F.when(F.col("__wiki"), "wiki").otherwise("md"))
    tried = asked.select(*keys, F.posexplode(options).alias("__place", "__path"))
    there = files.select(F.col(vault).alias("__vault"), F.col(path).alias("__path")).distinct()
    found = tried.join(there, ["__vault", "__path"]).groupBy(*keys).agg(F.min_by("__path", "__place").alias("resolved"))
    return keyed.join(found, list(keys), "left").drop(*keys)


@F.pandas_udf(StructType([StructField("mime", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _measure(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append((data and image_size(bytes(data))) or (None, None, None))
        except Exception:  # a header that can't be read is no image
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["mime", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def measured(content: Column) -> Column:
    """(mime, width, height, size_bytes, content_key) of an image's bytes; null if they are none, over IMAGE_BYTES, or
    show fewer than IMAGE_SIDE pixels either way."""
    size = F.octet_length(content)
    m = _measure(F.when((size > 0) & (size <= IMAGE_BYTES), content))
    fits = m["mime"].isNotNull() & (F.least(m["width"], m["height"]) >= IMAGE_SIDE)
    return F.when(fits, F.struct(m["mime"].alias("mime"), m["width"].alias("width"), m["height"].alias("height"), size.cast("long").alias("size_bytes"), F.sha2(content, 256).alias("content_key")))


def prepare(refs: DataFrame, files: DataFrame, vault: str = "vault", note: str = "note", target: str = "target", kind: str = "kind", path: str = "path", content: str = "content") -> DataFrame:
    """``refs`` with ``image``: (ok, source_kind, source_ref, content_key, mime, width, height, size_bytes, reason).

    Empty targets are refused; ``data:`` ones are embedded images, told by the
    hash of their bytes; ``http(s)`` ones are remote, told by the hash of their
    address and not loaded; all others are files.  Files are measured where they
    are read, so that their bytes are never shuffled.
    """
    t = strip(F.coalesce(F.col(target), F.lit("")))
    none = F.lit(None)
    embedded, remote = F.lower(t).startswith("data:"), t.rlike("(?i)^https?://")
    known = files.select(F.col(vault), F.col(path).alias("resolved"), measured(F.col(content)).alias("__file")).dropDuplicates([vault, "resolved"])
    found = resolve(refs, files, vault, note, target, kind, path).join(known, [vault, "resolved"], "left")
    found = found.withColumn("__own", measured(F.when(embedded, data_url(t)["bytes"])))

    def said(ok: bool, how: str | None, ref: Column, key: Column, m: Column | None, reason: str | None) -> Column:
        part = lambda n, as_type: (m[n] if m is not None else none).cast(as_type).alias(n)
        sizes = (part("mime", "string"), part("width", "int"), part("height", "int"), part("size_bytes", "long"))
        return F.struct(F.lit(ok).alias("ok"), F.lit(how).cast("string").alias("source_kind"), ref.cast("string").alias("source_ref"), key.cast("string").alias("content_key"), *sizes, F.lit(reason).cast("string").alias("reason"))

    refused = lambda why: said(False, None, none, none, None, why)
    image = (
        F.when(t == "", refused("empty_target"))
        .when(embedded & F.col("__own").isNull(), refused("invalid_data_url"))
        .when(embedded, said(True, "embedded", none, F.col("__own")["content_key"], F.col("__own"), None))
        .when(remote, said(True, "remote", t, F.sha2(t, 256), None, None))
        .when(F.col("resolved").isNull(), refused("not_found"))
        .when(F.col("__file").isNull(), refused("invalid_or_too_small"))
        .otherwise(said(True, "local", F.col("resolved"), F.col("__file")["content_key"], F.col("__file"), None))
    )
    return found.withColumn("image", image).drop("__file", "__own", "resolved")
