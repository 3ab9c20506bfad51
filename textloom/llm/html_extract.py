"""Main text of web pages as a maximum-scoring run of words and tags.

A page is read as a sequence of tags and stretches of text.  Each word scores
by the element that holds it, each tag scores below zero, and one linear scan
finds the contiguous run with the largest sum.  The weights are log-odds of
being inside the article, counted over labelled pages: those whose markup
names their article or main element.

The run alone decides the region: all between its ends stays, in page order, but
for text in menus, adverts, forms and the like.  A form or part of a class name
above an article or main element doesn't put it out.  Reading is linear in the
page, however broken its markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.util import small_batches

#: Labelled pages that weights are counted over, about.
SAMPLE = 2000
#: Elements and names of parts that aren't the article.
RAW = {"script", "style", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
UNSEEN = {"noscript", "template", "object", "canvas"}
SMALL = {"button", "select", "svg", "math"}
ASIDE = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "head", "fieldset"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
HOLDERS = ASIDE | MAIN | {"body", "div", "section", "td"}
#: Elements that end an open button, select, svg or math.
BLOCKS = HOLDERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "hr", "address", "details"}
NAMED = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|widget|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)
COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(tag, attributes, closing, text) in page order; text has an empty tag.

    What raw elements, comments and declarations hold is skipped; a raw element
    that is never closed ends with what is around it.  A ``<`` that opens no tag
    is text.  A ``>`` in quotes ends no tag, unless none outside them does.
    """
    n, last, quoted, absent = len(page), page.rfind(">"), True, set()

    def end_of_tag(at: int) -> int:
        nonlocal quoted
        first = page.find(">", at)
        while quoted:
            at = PLAIN.match(page, at).end()
            if at == n:
                quoted = False  # what follows is read without quotes, so that no part is read again and again
            elif page[at] == ">":
                return at + 1
            elif page[at] in absent or (close := page.find(page[at], at + 1)) < 0:
                absent.add(page[at])
                at += 1
            else:
                at = close + 1
        return first + 1

    at = text = 0
    while 0 <= (i := page.find("<", at)) < last:
        if page.startswith("<!--", i):
            close = page.find("-->", i + 4)
            tag, end = "", close + 3 if close >= 0 else n
        elif page[i + 1] in "!?":
            tag, end = "", page.find(">", i) + 1
        elif m := NAME.match(page, i + 1):
            tag, end = m[2].lower(), end_of_tag(m.end())
        else:
            at = i + 1
            continue
        if i > text:
            yield "", "", False, page[text:i]
        at = text = end
        if not tag:
            continue
        attributes = page[m.end() : end - 1]
        yield tag, attributes, bool(m[1]), ""
        if tag in RAW and not m[1] and not attributes.rstrip().endswith("/"):
            close = None if tag in absent else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close is None:
                absent.add(tag)
                close = page.find("</", at)
                at = text = close if close >= 0 else n
            else:
                at = text = close.end()
            yield tag, "", True, ""
    if text < n:
        yield "", "", False, page[text:]


def holder(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Key of an element for weights, and whether it is known to hold no article:
    at all, by its kind (all but forms), by a whole class name or id, by one of readers' comments."""
    named: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if m[1]:
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{named.get('class', '')} {named.get('id', '')}".strip()
    role = named.get("role", "").lower()
    hard = tag in ASIDE - FORMS or role in ROLES - FORMS or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
    part = bool(names) and tag not in ("html", "body") and bool(NAMED.search(names))
    wholes = {x.lower() for x in names.split() if (m := NAMED.search(x)) and m[1] == x} if part else set()
    return (f"{tag}.{names.lower().split()[0]}" if names else tag), hard or tag in FORMS or role in FORMS or part, hard, bool(wholes), bool(wholes & COMMENTS)


class Node:
    """A stretch of text with what is around it."""

    __slots__ = ("words", "text", "key", "out", "main", "tags", "split")

    def __init__(self, text: str, key: str, out: bool, main: str, tags: list[str], split: bool):
        self.text, self.words, self.key, self.out, self.main, self.tags, self.split = text, len(text.split()), key, out, main, tags, split


class Open:
    """An open element that matters: what its text is, and how often its tag was opened in it since."""

    __slots__ = ("tag", "key", "out", "main", "hard", "named", "again")

    def __init__(self, tag: str = "", key: str = "body", out: bool = False, main: str = "", hard: bool = False, named: bool = False):
        self.tag, self.key, self.out, self.main, self.hard, self.named, self.again = tag, key, out, main, hard, named, 0


def nodes(page: str) -> list[Node]:
    """The texts of a page; ``tags`` are those since the text before, ``main``
    names the innermost open article or main element, ``key`` begins with it,
    ``split`` tells if a block begins or ends in between.

    Names and forms above an article or main element count for it only where
    they are in another such element and a whole name says so (the articles of
    a list of comments); its own name counts if it tells readers' comments.
    Menus, asides and hidden elements always count.
    """
    out, stack, open_, tags, split = [], [Open()], Counter(), [], True

    def leave(depth: int) -> None:
        for x in stack[depth:]:
            open_[x.tag] -= 1
        del stack[depth:]

    def push(x: Open) -> None:
        stack.append(x)
        open_[x.tag] += 1

    for tag, attributes, closing, text in tokens(page):
        top = stack[-1]
        if not tag:
            out.append(Node(html.unescape(text), f"{top.main} {top.key}" if top.main else top.key, top.out, top.main, tags, split))
            tags, split = [], False
            continue
        tags.append(("/" if closing else "") + tag)
        split = split or tag not in INLINE
        if tag in VOID or tag in RAW:
            continue
        if closing:
            if open_[tag]:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if i == len(stack) - 1 and top.again:
                    top.again -= 1
                else:
                    leave(i)
            continue
        if tag in BLOCKS and top.tag in SMALL:
            while stack[-1].tag in SMALL:
                leave(len(stack) - 1)
            top = stack[-1]
        if tag in UNSEEN or tag in SMALL:
            if not attributes.rstrip().endswith("/"):
                push(Open(tag, tag, True, top.main, True, top.named))
            continue
        if tag in HOLDERS or attributes:
            key, aside, hard, named, comment = holder(tag, attributes)
            if tag in HOLDERS or aside:
                hard, named = top.hard or hard, top.named or (named and tag not in MAIN) or comment
                off = hard or bool(named and (comment or top.main)) if tag in MAIN else top.out or aside
                push(Open(tag, key, off, tag if tag in MAIN else top.main, hard, named and (off or tag not in MAIN)))
                continue
        if tag == top.tag:
            top.again += 1
    return out


def count(pages: Iterator[str]) -> Counter:
    """(kind, key, inside) counts over labelled pages: words by holder, tags by name."""
    seen: Counter = Counter()
    for page in pages:
        parts = nodes(page)
        if not any(p.main for p in parts):
            continue
        for p in parts:
            inside = bool(p.main) and not p.out
            for key in {p.key, p.key.split(" ")[0]}:
                seen["word", key, inside] += p.words
            for t in p.tags:
                seen["tag", t, inside] += 1
    return seen


def weights(seen: Counter) -> dict[tuple[str, str], float]:
    """Log-odds of words by holder, within -3 and 3; tags get the log of their share inside, below zero."""
    out = {}
    for kind, key in {(k, n) for k, n, _ in seen}:
        a, b = seen[kind, key, True] + 0.5, seen[kind, key, False] + 0.5
        out[kind, key] = max(-3.0, min(3.0, math.log(a / b))) if kind == "word" else max(-4.0, math.log(a / (a + b))) - 0.01
    return out


UNSEEN_WORD, UNSEEN_TAG, ASIDE_WORD = 1.0, -0.5, -2.0


def best_run(parts: list[Node], w: dict[tuple[str, str], float], told: bool = True) -> tuple[int, int]:
    """(first, last + 1) of the run of texts with the largest sum; (0, 0) if none is above zero.

    An element that no labelled page has in an article counts as the article does.  Unless ``told``, all words score
    alike: where a page names no article, the labelled pages tell nothing of its elements.
    """
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(parts):
        run += sum(w.get(("tag", t), UNSEEN_TAG) for t in p.tags)
        if run <= 0:
            run, start = 0.0, i
        run += p.words * (ASIDE_WORD if p.out else w.get(("word", p.key), w.get(("word", p.key.split(" ")[0]), UNSEEN_WORD)) if told else UNSEEN_WORD)
        if run > best:
            best, at = run, (start, i + 1)
    return at


def main_text(page: str | None, w: dict[tuple[str, str], float]) -> str:
    """The main text of a page; empty for null, empty and textless pages."""
    parts = nodes(page or "")
    a, b = best_run(parts, w, any(p.main for p in parts))
    blocks: list[list[str]] = []
    for p in parts[a:b]:
        if p.split or not blocks:
            blocks.append([])
        if not p.out:
            blocks[-1].append(p.text)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[tuple[str, str], float]:
    """Weights from at most ``2 * sample`` labelled pages, those with the least hashes of their markup, equal ones once."""
    step = max(1, pages.count() // sample)
    some = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(html_col).alias("h")).where(F.pmod("h", F.lit(step)) == 0)
    some = some.dropDuplicates(["h"]).orderBy("h").limit(2 * sample).repartition(16, "h").select("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in batches:
            seen += count(x for x in b.column(0).to_pylist() if x)
        rows = [(k, n, i, c) for (k, n, i), c in seen.items()]
        c = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.int64())], names=["kind", "key", "inside", "n"])

    total = some.mapInArrow(work, "kind string, key string, inside boolean, n bigint").groupBy("kind", "key", "inside").agg(F.sum("n").alias("n"))
    return weights(Counter({(r["kind"], r["key"], r["inside"]): r["n"] for r in total.collect()}))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", w: dict | None = None) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page.

    Equal rows each give a row, as do null and empty pages (empty text); very
    long pages are read whole.  Of the columns only ``keep`` and ``html_col``
    are read; ones called text or n_chars give way.
    """
    small_batches(pages.sparkSession)
    w = w or fit(pages, html_col)
    kept = [c for c in keep if c not in ("text", "n_chars")]
    source = pages.select(*kept, F.col(html_col).cast("string").alias("__html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x, w) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "text string", "n_chars bigint"])
    return source.mapInArrow(work, ddl)
