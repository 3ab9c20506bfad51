"""Changes of an index: files in, moved and out, caches, vault state, keys and runs.

All take DataFrames and return the table's new rows; :class:`textloom.tables.Table`
makes them durable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import content_hash, image_uid, is_image_shell, vector_id
from textloom.operators.chunk import chunks


def index_rows(docs: DataFrame, limit: int = 800) -> DataFrame:
    """Chunks with vector ids of parsed documents (vault_id, note_id, format, content).

    Chunks that hold nothing but image references are left out before they are
    numbered; ``chunk_index`` keeps the splitter's number.
    """
    cut = chunks(docs, "content", F.col("format"), ["vault_id", "note_id"], limit).where(~is_image_shell(F.col("text"), F.col("breadcrumb")))
    whole = cut.groupBy("vault_id", "note_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", "char_start", "char_end", "breadcrumb", "heading"))).alias("c"))
    out = whole.select("vault_id", "note_id", F.posexplode("c").alias("idx", "c")).select("vault_id", "note_id", "idx", "c.*")
    return out.withColumn("vector_id", vector_id(F.col("vault_id"), F.col("note_id"), F.col("idx")))


def upsert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes by (vault, path)."""
    return notes.join(new.select("vault_id", "file_path"), ["vault_id", "file_path"], "left_anti").unionByName(new, allowMissingColumns=True)


def replace_chunks(chunks_: DataFrame, notes: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Chunks of the notes (note_id) anew.  With ``strict`` a note without new chunks keeps its old ones."""
    gone = new.select("note_id").distinct() if strict else notes.select("note_id").distinct()
    return chunks_.join(gone, "note_id", "left_anti").unionByName(new, allowMissingColumns=True)


def drop_files(notes: DataFrame, chunks_: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, chunks and vectors without the files ``gone`` (vault_id, file_path)."""
    ids = notes.join(gone, ["vault_id", "file_path"], "left_semi").select(F.col("id").alias("note_id"))
    return notes.join(gone, ["vault_id", "file_path"], "left_anti"), chunks_.join(ids, "note_id", "left_anti"), vectors.join(ids, "note_id", "left_anti")


def move_files(notes: DataFrame, moved: DataFrame) -> DataFrame:
    """New paths (vault_id, old_path, new_path); title, size and time stay, and nothing is embedded again."""
    m = moved.select("vault_id", F.col("old_path").alias("file_path"), "new_path")
    return notes.join(m, ["vault_id", "file_path"], "left").withColumn("file_path", F.coalesce("new_path", "file_path")).drop("new_path").select(*notes.columns)


def clear_vaults(tables: dict[str, DataFrame], vaults: DataFrame, user_id: str, whole: bool = False) -> dict[str, DataFrame]:
    """Tables without what belongs to some of a user's vaults; with ``whole`` also the vaults and their runs.

    Conversations stay, and so does what other users own.
    """
    own = tables["vaults"].where(F.col("user_id") == user_id).join(vaults.select("id"), "id", "left_semi").select(F.col("id").alias("vault_id"))
    names = ["notes", "chunks", "vectors", *(["runs"] if whole else [])]
    out = dict(tables) | {n: tables[n].join(own, "vault_id", "left_anti") for n in names if n in tables}
    if whole:
        out["vaults"] = tables["vaults"].join(own.select(F.col("vault_id").alias("id")), "id", "left_anti")
    return out


def touch_embed_state(vaults: DataFrame, vault_id: int, profile_id: int, at: Column) -> DataFrame:
    """The vault is now indexed under a profile, which is added to those it ever was."""
    here = F.col("id") == vault_id
    known = F.coalesce("embed_indexed_profiles", F.array().cast("array<int>"))
    return vaults.withColumns(
        {
            "embed_indexed_profiles": F.when(here, F.array_union(known, F.array(F.lit(profile_id)))).otherwise(F.col("embed_indexed_profiles")),
            "embed_profile_id": F.when(here, F.lit(profile_id)).otherwise(F.col("embed_profile_id")),
            "indexed_at": F.when(here, at).otherwise(F.col("indexed_at")),
        }
    )


def cache_images(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Descriptions by (user, content key); an empty new source keeps the old one, a missing uid is filled."""
    key = ["user_id", "content_key"]
    old = cache.select(*key, F.col("source_ref").alias("__ref"))
    kept = new.where(F.coalesce(F.col("content"), F.lit("")) != "").join(old, key, "left")
    fresh = kept.withColumn("source_ref", F.coalesce(F.nullif("source_ref", F.lit("")), "__ref")).drop("__ref")
    out = cache.join(new.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    return out.withColumn("uid", F.coalesce("uid", image_uid(F.col("user_id"), F.col("content_key"))))


def to_describe(refs: DataFrame, cache: DataFrame) -> DataFrame:
    """Images (user_id, content_key) without a description that isn't empty."""
    return refs.join(cache.where(F.coalesce(F.col("content"), F.lit("")) != "").select("user_id", "content_key"), ["user_id", "content_key"], "left_anti")


def touch_key(keys: DataFrame, key_hash: str, now: Column, every: int = 60) -> DataFrame:
    """A key's time of use, written once a minute at most."""
    stale = F.col("last_used_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_used_at") >= every)
    hit = (F.col("key_hash") == key_hash) & F.col("revoked_at").isNull() & stale
    return keys.withColumn("last_used_at", F.when(hit, now).otherwise(F.col("last_used_at")))


def revoke_key(keys: DataFrame, key_id: int, now: Column) -> DataFrame:
    """Revoked from now, or from when it was before."""
    return keys.withColumn("revoked_at", F.when(F.col("id") == key_id, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def refresh_signatures(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """Sizes and times of files whose content is the same, so that they aren't hashed again."""
    s = seen.select(F.col("rel_path").alias("file_path"), F.col("size_bytes").alias("__s"), F.col("mtime_ns").alias("__m"), F.col("content_hash").alias("__h"))
    same = F.col("content_hash") == F.col("__h")
    joined = notes.join(s, "file_path", "left")
    return joined.withColumns({"size_bytes": F.when(same, F.col("__s")).otherwise(F.col("size_bytes")), "mtime_ns": F.when(same, F.col("__m")).otherwise(F.col("mtime_ns"))}).select(*notes.columns)


def splice_images(chunks_: DataFrame, refs: DataFrame, most: int = 20) -> DataFrame:
    """Chunks (doc, chunk_index, text) with references (doc, raw, uid, description, ord) replaced by their descriptions.

    The first place of each reference counts; offsets are those before the
    replacement.  At most ``most`` references of a document are used.
    """
    used = refs.where((F.col("ord") < most) & (F.coalesce(F.col("description"), F.lit("")) != ""))
    at = F.expr("locate(raw, text) - 1")
    met = chunks_.join(used, "doc").where(F.expr("locate(raw, text) > 0")).select("doc", "chunk_index", F.struct(at.alias("offset"), "raw", "uid", "description").alias("i"))
    listed = met.groupBy("doc", "chunk_index").agg(F.array_sort(F.collect_list("i")).alias("images"))
    joined = chunks_.join(listed, ["doc", "chunk_index"], "left")

    def step(text: Column, i: Column) -> Column:
        block = F.concat(F.lit("<!-- IMAGE_START -->\n"), i["description"], F.lit("\n<!-- IMAGE_END -->"))
        return F.concat(F.substring(text, F.lit(1), i["offset"]), block, F.substring(text, i["offset"] + F.length(i["raw"]) + 1, F.length(text)))

    spliced = F.aggregate(F.reverse("images"), F.col("text"), step)
    return joined.withColumn("text", F.when(F.col("images").isNotNull(), spliced).otherwise(F.col("text")))


def file_hash(content: Column) -> Column:
    return content_hash(content)
