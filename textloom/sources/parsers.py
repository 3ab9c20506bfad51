"""Parsers from file bytes to text: Markdown, plain text, HTML, Word and Excel.

``parse`` maps (rel_path, content) rows to documents.  A parser is a function
from bytes to :class:`Parsed`; ``PARSERS`` lists them by extension and may be
extended.  Word and Excel are read with the standard library.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.paths import chunk_format
from textloom.functions.text import image_refs

# Names in the two file formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A_EMBED = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
# Monospaced fonts by their whole name without blanks, hyphens and underscores; others are told by a part.
MONO_NAMES = {"monaco", "menlo", "hack", "inconsolata", "fira", "cascadiacode", "sourcecodepro", "lucidaconsole", "andale", "ptmono"}
MONO_PART = re.compile(r"^courier|consol|mono$")


def monospaced(font: str) -> bool:
    """Whether a font of this name has letters of one width."""
    bare = font.lower().translate({ord(c): None for c in " \t-_"})
    return bare in MONO_NAMES or bool(MONO_PART.search(bare))


class NotAvailable(RuntimeError):
    """A format whose library isn't installed."""


@dataclass
class Parsed:
    content: str
    meta: dict[str, str] = field(default_factory=dict)


def text(data: bytes) -> Parsed:
    return Parsed(data.decode("utf-8", "replace"))


def pdf(data: bytes) -> Parsed:
    raise NotAvailable("PDF needs a library that is not installed")


# ------------------------------------------------------------------- tables


def cell(value: object) -> str:
    """A value in one line of a pipe table."""
    return re.sub(r"\r\n|\n|\r", " ", "" if value is None else str(value).strip()).replace("|", "\\|")


def pipe_table(rows: list[list[str]]) -> str:
    """Rows of unlike width as a pipe table; the first is its head."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


# -------------------------------------------------------------------- Excel


def excel(data: bytes) -> Parsed:
    """Each sheet under its name as a table; blank rows and empty sheets are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        blocks, titles = [], []
        for sheet in xml("xl/workbook.xml").iter(f"{S}sheet"):
            titles.append(sheet.get("name"))
            path = targets[sheet.get(f"{R}id")]
            rows = sheet_rows(xml(path.lstrip("/") if path.startswith("/") else posixpath.normpath(f"xl/{path}")), shared)
            if rows:
                blocks += [f"# {titles[-1]}", pipe_table(rows)]
    return Parsed("\n\n".join(blocks), {"source_type": "excel", "sheets": ",".join(titles)})


def sheet_rows(root: ElementTree.Element, shared: list[str]) -> list[list[str]]:
    out = []
    for row in root.iter(f"{S}row"):
        cells: list[str] = []
        for c in row.iter(f"{S}c"):
            letters = re.match("[A-Z]*", c.get("r") or "")[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            value, kind = c.findtext(f"{S}v"), c.get("t")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif kind == "b" and value is not None:
                value = "True" if value == "1" else "False"
            cells += [""] * ((at or len(cells) + 1) - 1 - len(cells)) + [cell(value)]
        if any(cells):
            out.append(cells)
    return out


# --------------------------------------------------------------------- Word


def word(data: bytes) -> Parsed:
    """Paragraphs and tables in the order of the body; headings by style, runs of code as a fence, images as markers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    items, images = [], 0
    for child in body:
        if child.tag == f"{W}tbl":
            rows = [[cell("\n".join(paragraph(p) for p in tc.iter(f"{W}p"))) for tc in tr.findall(f"{W}tc")] for tr in child.iter(f"{W}tr")]
            rows = [r for r in rows if r]
            if rows:
                items.append(("block", pipe_table(rows)))
        elif child.tag == f"{W}p":
            line = paragraph(child)
            if is_code(child):
                items.append(("code", line))
                continue
            level = heading(child)
            if line.strip():
                items.append(("block", f"{'#' * level} {line.strip()}" if level else line))
            else:
                items.append(("blank", ""))
            for _ in child.iter(A_EMBED):
                items.append(("block", f"![图片](docx-media:{images})"))
                images += 1
    return Parsed("\n\n".join(coalesce(items)), {"source_type": "docx", "images": str(images)})


def paragraph(p: ElementTree.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag == f"{W}br":
            out.append("\n")
    return "".join(out)


def style(p: ElementTree.Element) -> str:
    s = p.find(f"{W}pPr/{W}pStyle")
    return s.get(f"{W}val") if s is not None else ""


def heading(p: ElementTree.Element) -> int:
    name = style(p).replace(" ", "").lower()
    if name in ("title", "subtitle"):
        return 1 if name == "title" else 2
    m = re.fullmatch(r"(?:heading|标题)?([1-9])", name)
    return min(6, int(m[1])) if m else 0


def is_code(p: ElementTree.Element) -> bool:
    """A code style, or every run with text in a font of fixed width."""
    if re.search(r"code|source|preformatted", style(p), re.I):
        return True
    runs = [r for r in p.iter(f"{W}r") if "".join(t.text or "" for t in r.iter(f"{W}t")).strip()]
    fonts = [r.find(f"{W}rPr/{W}rFonts") for r in runs]
    return bool(runs) and all(f is not None and monospaced(f.get(f"{W}ascii") or "") for f in fonts)


def coalesce(items: list[tuple[str, str]]) -> Iterator[str]:
    """Runs of code lines, with blank lines between them, as one block: fenced from two lines on."""
    marked, code = [], False
    for i, (kind, line) in enumerate(items):
        ahead = next((k for k, _ in items[i + 1 :] if k != "blank"), "")
        code = kind == "code" or kind == "blank" and code and ahead == "code"
        marked.append((code, kind, line))
    for code, run in groupby(marked, key=lambda x: x[0]):
        lines = [x[2] for x in run if code or x[1] != "blank"]
        if not code:
            yield from lines
        elif len([x for x in lines if x.strip()]) >= 2 or any("\n" in x for x in lines):
            whole = "\n".join(lines)
            mark = "~~~" if "```" in whole else "```"
            yield f"{mark}\n{whole}\n{mark}"
        else:
            yield from (x for x in lines if x.strip())


PARSERS: dict[str, Callable[[bytes], Parsed]] = {".md": text, ".markdown": text, ".txt": text, ".html": text, ".htm": text, ".docx": word, ".xlsx": excel, ".xlsm": excel, ".pdf": pdf}


def parse(files: DataFrame) -> DataFrame:
    """Documents of files (rel_path, content): title, format, content, meta, images and error.

    Files without a parser are left out; one that fails has its error and no
    content, and the others go on.
    """
    known = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    source = files.where(known.isin(*PARSERS)).select("rel_path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.rel_path, batch.content):
                name = posixpath.basename(path)
                try:
                    p = PARSERS[posixpath.splitext(name)[1].lower()](bytes(data))
                    rows.append((path, posixpath.splitext(name)[0], p.content, p.meta, None))
                except Exception as e:
                    rows.append((path, posixpath.splitext(name)[0], None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["rel_path", "title", "content", "meta", "error"])

    done = source.mapInPandas(work, "rel_path string, title string, content string, meta map<string,string>, error string")
    return done.withColumns({"format": chunk_format(F.col("rel_path")), "images": image_refs(F.coalesce("content", F.lit("")))})


def read_files(spark, root: str) -> DataFrame:
    """(rel_path, content) of a folder's files, hidden ones apart."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    return raw.select(F.expr(f"substring(path, instr(path, {base!r}) + {len(base)})").alias("rel_path"), "content")


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(mime, width, height) from the header of a PNG, GIF, JPEG, WebP, BMP or TIFF."""
    big, little = (lambda a, n: int.from_bytes(data[a : a + n], "big")), (lambda a, n: int.from_bytes(data[a : a + n], "little"))
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "image/png", big(16, 4), big(20, 4)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "image/gif", little(6, 2), little(8, 2)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "image/webp", little(24, 3) + 1, little(27, 3) + 1
        if data[12:16] == b"VP8L" and data[20] == 0x2F:
            return "image/webp", (little(21, 4) & 0x3FFF) + 1, (little(21, 4) >> 14 & 0x3FFF) + 1
        if data[12:16] == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            return "image/webp", little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
        return None
    if data[:2] == b"BM" and len(data) >= 26:
        if little(14, 4) == 12:
            return "image/bmp", little(18, 2), little(20, 2)
        return "image/bmp", little(18, 4), abs(int.from_bytes(data[22:26], "little", signed=True))  # rows from the top count down
    if data[:4] in (b"II*\0", b"MM\0*"):
        number = little if data[:2] == b"II" else big
        at, sides = number(4, 4), {}
        for k in range(number(at, 2)):
            entry = at + 2 + 12 * k
            if entry + 12 <= len(data) and number(entry, 2) in (256, 257):
                sides[number(entry, 2)] = number(entry + 8, 2 if number(entry + 2, 2) == 3 else 4)
        return ("image/tiff", sides[256], sides[257]) if len(sides) == 2 else None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], big(at + 2, 2)
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "image/jpeg", big(at + 7, 2), big(at + 5, 2)
            at += 2 + size
    return None


#: Limits of images that are described.
IMAGE_BYTES, IMAGE_SIDE = 5 * 1024 * 1024, 200


def admissible(data: bytes) -> bool:
    size = image_size(data) if len(data) <= IMAGE_BYTES else None
    return bool(size) and min(size[1], size[2]) >= IMAGE_SIDE
