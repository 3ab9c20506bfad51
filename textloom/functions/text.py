"""Text functions, as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of queries.
STOP_WORDS = (
    "是", "什么", "怎么", "如何", "怎样", "为什么", "的", "了", "在",
    "和", "与", "用", "吗", "呢", "请", "what", "is", "how", "to",
    "use", "the", "a", "an", "and", "or", "of", "for", "in", "on",
    "with", "do", "does", "can", "you", "me", "it",
)

#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Han and kana; and letters and digits without them.  ASCII is told by ranges first: scripts are looked up slowly.
HAN = r"\x{80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
LETTERS = r"a-z0-9[\x{80}-\x{10FFFF}&&[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]]"
SPACE = r"(?U)\s+"


def fold(c: Column) -> Column:
    """Lower case without accents; texts without any aren't translated."""
    low = F.lower(c)
    return F.when(low.rlike(f"[{ACCENTED}]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def strip(c: Column) -> Column:
    """Without white space at both ends; all of Unicode's, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def pairs(w: Column) -> Column:
    """Overlapping pairs of a run's characters; a single one stays."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))


def words(c: Column) -> Column:
    """Terms of a text in order: runs of letters and digits, folded; Han and kana as pairs.

    Null gives no terms.  ``operators.segment`` cuts Han by a dictionary instead.
    """
    runs = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(rf"[{LETTERS}]+|[{HAN}]+"), F.lit(0))
    has_han = F.coalesce(c, F.lit("")).rlike(f"[{HAN}]")
    return F.when(has_han, F.flatten(F.transform(runs, lambda w: F.when(w.rlike(f"^[{HAN}]"), pairs(w)).otherwise(F.array(w))))).otherwise(runs)


def query_terms(c: Column, stop: tuple[str, ...] = STOP_WORDS, cut: Callable[[Column], Column] = words) -> Column:
    """Distinct informative terms in order of first use; null if there are none.  ``cut`` gives a text's terms."""
    kept = F.array_distinct(F.filter(cut(c), lambda w: ~w.isin(*stop)))
    return F.when(F.size(kept) > 0, kept)


# Entities that tag stripping decodes, the ampersand last so that
# what it gives is not decoded again.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(c: Column) -> Column:
    """Text without tags, with six entities decoded once."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def table_to_pipes(table: Column) -> Column:
    """An HTML table as a pipe table; a first row with header cells gets a separator below."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip))
    filled = F.filter(cells, lambda r: F.size(r) > 0)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size(filled[0])), "|"), F.lit("|"))
    head = F.exists(rows, lambda r: F.lower(r).contains("<th"))
    lines = F.concat(F.array(line(filled[0])), F.when(head, F.array(rule)).otherwise(F.array().cast("array<string>")), F.transform(F.slice(filled, F.lit(2), F.size(filled)), line))
    return F.when(F.size(filled) == 0, strip_html(table)).otherwise(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")))


def html_text(c: Column) -> Column:
    """Whole text of a page: tags stripped, white space merged."""
    return F.trim(F.regexp_replace(strip_html(c), r"\s+", " "))


def html_headings(c: Column) -> Column:
    """Array of (level, title) of a page's headings."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    return F.transform(
        found,
        lambda h: F.struct(F.regexp_extract(h, r"(?i)^<h([1-6])", 1).cast("int").alias("level"), strip(strip_html(F.regexp_extract(h, r"(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$", 1))).alias("title")),
    )


def markdown_headings(c: Column) -> Column:
    """Array of (level, title) of a Markdown text's headings."""
    found = F.regexp_extract_all(c, F.lit(r"(?md)^#{1,6}\s+.+$"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#{1,6})", 1)).alias("level"), strip(F.regexp_replace(h, r"^#{1,6}\s+", "")).alias("title")))


def breadcrumbs(headings: Column) -> Column:
    """For each heading its path ``A > B``: the nearest heading of each smaller level before it.

    Levels on the path always grow, so that dropping all of the same level or
    deeper leaves what a stack would.
    """
    empty = F.array().cast("array<struct<level:int,title:string>>")
    state = F.struct(empty.alias("path"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        path = F.concat(F.filter(s["path"], lambda x: x["level"] < h["level"]), F.array(h))
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(F.array_join(F.transform(path, lambda x: x["title"]), " > "))).alias("out"))

    return F.aggregate(headings, state, step, lambda s: s["out"])


def mask_key(c: Column) -> Column:
    """A key with its middle hidden: short ones keep one character, longer ones four and two."""
    n = F.length(c)
    short = F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(0))))
    return F.when(n == 0, "").when(n <= 8, short).otherwise(F.concat(F.substring(c, 1, 4), F.lit("****"), F.substring(c, F.length(c) - 1, F.lit(2))))


TITLE_CHARS, UNTITLED = 24, "新对话"


def derive_title(c: Column) -> Column:
    """First words of a message: white space merged, 24 characters and an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))
    return F.when(flat == "", UNTITLED).when(F.length(flat) > TITLE_CHARS, F.concat(F.substring(flat, 1, TITLE_CHARS), F.lit("…"))).otherwise(flat)


def content_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def image_uid(user: Column, key: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(F.sha2(F.concat_ws(":", user, key), 256), 1, 16))


def vector_id(vault: Column, note: Column, idx: Column) -> Column:
    return F.concat(F.lit("v"), vault.cast("string"), F.lit("_n"), note.cast("string"), F.lit("_c"), idx.cast("string"))


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, with or without zone, taken as UTC."""
    return F.unix_millis(c.cast("timestamp"))


def elapsed_ms(started: Column, now: Column) -> Column:
    """Milliseconds that a run took so far; null before it started."""
    return epoch_ms(now) - epoch_ms(started)


def profile_params(c: Column) -> Column:
    """A profile's parameters from JSON; bad text gives none."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def chunk_meta(base: Column, breadcrumb: Column, heading: Column, extra: Column) -> Column:
    """A chunk's metadata (map of texts): breadcrumb and heading if they say something; ``extra`` overrides all."""
    said = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.create_map(F.lit(k), c)).otherwise(F.create_map().cast("map<string,string>"))
    own = F.map_concat(base, said("breadcrumb", breadcrumb), said("heading", heading))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def flat_meta(c: Column) -> Column:
    """A nested value as JSON text."""
    return F.to_json(c)


def parse_images(c: Column, schema: str = "array<struct<uid:string,ref:string,kind:string,raw:string,alt:string,offset:int,model:string>>") -> Column:
    """Image records of a JSON text; bad text gives none and what is no record is dropped."""
    return F.coalesce(F.filter(F.from_json(c, schema), lambda x: x.isNotNull()), F.array().cast(schema))


def parse_int_list(c: Column) -> Column:
    """Whole numbers of a JSON list; anything else gives none."""
    return F.coalesce(F.filter(F.from_json(c, "array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def fence(c: Column) -> Column:
    """A code block; its marks change when the code has backticks."""
    mark = F.when(c.contains("```"), F.lit("~~~")).otherwise(F.lit("```"))
    return F.concat(mark, F.lit("\n"), c, F.lit("\n"), mark)


def is_image_shell(c: Column, breadcrumb: Column | None = None) -> Column:
    """True if nothing but image references is left below the chunk's own breadcrumb; a null one is none.

    Without ``breadcrumb`` a first line in brackets counts as one.
    """
    if breadcrumb is None:
        below = F.regexp_replace(c, r"^\[[^\]]*\]\n", "")
    else:
        head = F.concat(F.lit("["), breadcrumb, F.lit("]\n"))
        below = F.when(F.coalesce(c.startswith(head), F.lit(False)), F.substring(c, F.length(head) + 1, F.length(c))).otherwise(c)
    return strip(F.regexp_replace(below, r"!\[[^\]]*\]\([^)]*\)", "")) == ""


def data_url(c: Column) -> Column:
    """(mime, bytes) of a base64 data URL; null bytes if it is none."""
    mime = F.regexp_extract(c, r"(?is)^data:([^;,]*)[^,]*;base64,", 1)
    body = F.regexp_extract(c, r"(?is)^data:[^,]*;base64,(.*)$", 1)
    return F.struct(mime.alias("mime"), F.when(c.rlike(r"(?is)^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64"))).alias("bytes"))


_REF = "struct<raw:string,start:int,end:int,alt:string,target:string,kind:string>"
# Patterns of image references in Markdown, wiki links and HTML.
MD_IMAGE = r"""!\[([^\]]*)\]\(\s*(<[^>]*>|[^)\s]+)(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)"""
WIKI_IMAGE = r"!\[\[([^\]|#^]+)(?:#[^\]|]*)?(?:\|([^\]]+))?\]\]"
HTML_IMAGE = r"""(?i)<img\b[^>]*?\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>"""


def image_refs(c: Column) -> Column:
    """Image references in order of place; of overlapping ones the first stays.

    Places are code points, end exclusive.
    """
    none = F.array().cast(f"array<{_REF}>")

    def located(pattern: str, alt, target, kind: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

        def step(s: Column, m: Column) -> Column:
            at = F.call_function("locate", m, c, s["pos"])
            ref = F.struct(m.alias("raw"), (at - 1).alias("start"), (at - 1 + F.length(m)).alias("end"), alt(m).alias("alt"), target(m).alias("target"), F.lit(kind).alias("kind"))
            return F.struct((at + F.length(m)).alias("pos"), F.concat(s["out"], F.array(ref)).alias("out"))

        return F.aggregate(found, F.struct(F.lit(1).alias("pos"), none.alias("out")), step, lambda s: s["out"])

    group = lambda p, i: lambda m: strip(F.regexp_extract(m, p, i))
    bare = lambda m: strip(F.regexp_replace(F.regexp_extract(m, MD_IMAGE, 2), r"(?s)^<(.*)>$", "$1"))
    alias = lambda m: F.when(group(WIKI_IMAGE, 2)(m).rlike(r"^\d+$"), "").otherwise(group(WIKI_IMAGE, 2)(m))
    source = lambda m: strip(F.concat(*(F.regexp_extract(m, HTML_IMAGE, i) for i in (1, 2, 3))))
    every = F.concat(
        located(MD_IMAGE, group(MD_IMAGE, 1), bare, "md"),
        located(WIKI_IMAGE, alias, group(WIKI_IMAGE, 1), "wiki"),
        F.filter(located(HTML_IMAGE, lambda m: F.lit(""), source, "html"), lambda r: r["target"] != ""),
    )
    ordered = F.array_sort(every, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    apart = lambda s, r: F.when((F.size(s) > 0) & (r["start"] < F.element_at(s, -1)["end"]), s).otherwise(F.concat(s, F.array(r)))
    return F.aggregate(ordered, none, apart)
