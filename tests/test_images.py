"""Image references: resolution and preparation, case by case, and measures of each format."""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import functions as F

from textloom.operators import images
from textloom.sources.parsers import image_size


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\0" * 8


def webp(kind, rest):
    return b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + rest


def tiff(order, w, h):
    entries = b"".join(struct.pack(order + "HHI", tag, 3, 1) + struct.pack(order + "HH", v, 0) for tag, v in ((256, w), (257, h)))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2) + entries


def test_sizes():
    assert image_size(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 640, -480)) == ("image/bmp", 640, 480)
    assert image_size(b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 7, 9) + b"\0" * 8) == ("image/bmp", 7, 9)
    assert image_size(webp(b"VP8X", b"\0" * 4 + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"))) == ("image/webp", 300, 200)
    assert image_size(webp(b"VP8L", b"\x2f" + (299 | 199 << 14).to_bytes(4, "little") + b"\0" * 8)) == ("image/webp", 300, 200)
    assert image_size(webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200))) == ("image/webp", 300, 200)
    assert image_size(tiff("<", 300, 200)) == image_size(tiff(">", 300, 200)) == ("image/tiff", 300, 200)
    assert image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("image/gif", 3, 4)
    assert image_size(webp(b"VP8?", b"\0" * 20)) is None and image_size(b"II*\0") is None and image_size(b"") is None


FILES = ["img/pic.png", "attachments/diagram.png", "img/my pic.png", "assets/flow.png", "sub/near.png", "near.png", "a+b.png", "plus b.png", "files/both.gif", "media/both.png", "100%.png"]
CASES = [
    ("note.md", "md", "img/pic.png", "img/pic.png"),
    ("sub/note.md", "md", "img/pic.png", None),  # only wiki links fall back to the root
    ("sub/note.md", "md", "../img/pic.png", "img/pic.png"),
    ("sub/note.md", "wiki", "diagram.png", "attachments/diagram.png"),
    ("note.md", "wiki", "diagram", "attachments/diagram.png"),
    ("note.md", "wiki", "flow", "assets/flow.png"),
    ("note.md", "md", "img/my%20pic.png", "img/my pic.png"),
    ("note.md", "html", "./img//pic.png", "img/pic.png"),
    ("sub/note.md", "wiki", "near.png", "sub/near.png"),
    ("other/note.md", "wiki", "near.png", "near.png"),
    ("sub/note.md", "md", "../../secret.png", None),
    ("sub/note.md", "md", "/img/pic.png", None),
    ("note.md", "md", "a+b.png", "a+b.png"),
    ("note.md", "md", "plus+b.png", None),
    ("note.md", "wiki", "both", "media/both.png"),
    ("note.md", "md", "100%.png", "100%.png"),
    ("note.md", "md", "", None),
    ("note.md", "md", None, None),
    (None, "md", "img/pic.png", None),
]


def test_resolution(spark):
    refs = spark.createDataFrame([(i, 1, *c) for i, c in enumerate(CASES)], "i int, vault int, note string, kind string, target string, want string")
    files = spark.createDataFrame([(v, p, 0) for v, p in [(1, p) for p in FILES] * 2 + [(2, "secret.png")]], "vault int, path string, i int")
    got = {r["i"]: (r["target"], r["resolved"]) for r in images.resolve(refs, files).collect()}
    assert got == {i: (c[2], c[3]) for i, c in enumerate(CASES)}
    assert images.resolve(refs.limit(0), files).count() == 0
    assert {r["resolved"] for r in images.resolve(refs, files.limit(0)).collect()} == {None}


def test_preparation(spark):
    good, small = png(300, 200), png(50, 50)
    url = "data:image/png;base64," + base64.b64encode(good).decode()
    rows = [
        ("img/good.png", (True, "local", "img/good.png", hashlib.sha256(good).hexdigest(), "image/png", 300, 200, len(good), None)),
        ("small.png", (False, None, None, None, None, None, None, None, "invalid_or_too_small")),
        ("broken.png", (False, None, None, None, None, None, None, None, "invalid_or_too_small")),
        ("large.png", (False, None, None, None, None, None, None, None, "invalid_or_too_small")),
        ("nope.png", (False, None, None, None, None, None, None, None, "not_found")),
        ("  ", (False, None, None, None, None, None, None, None, "empty_target")),
        (None, (False, None, None, None, None, None, None, None, "empty_target")),
        (url, (True, "embedded", None, hashlib.sha256(good).hexdigest(), "image/png", 300, 200, len(good), None)),
        ("data:image/png;base64,!!", (False, None, None, None, None, None, None, None, "invalid_data_url")),
        ("data:image/png;base64," + base64.b64encode(small).decode(), (False, None, None, None, None, None, None, None, "invalid_data_url")),
        ("HTTPS://a.example/x.png", (True, "remote", "HTTPS://a.example/x.png", hashlib.sha256(b"HTTPS://a.example/x.png").hexdigest(), None, None, None, None, None)),
    ]
    refs = spark.createDataFrame([(i, 1, "note.md", "md", t) for i, (t, _) in enumerate(rows)], "i int, vault int, note string, kind string, target string")
    files = spark.createDataFrame([(1, "img/good.png", good), (1, "small.png", small), (1, "broken.png", b"?"), (1, "large.png", good + b"\0" * (5 << 20)), (1, "none.png", None)], "vault int, path string, content binary")
    assert {r["i"]: tuple(r["image"]) for r in images.prepare(refs, files).collect()} == {i: w for i, (_, w) in enumerate(rows)}


def test_root(spark):
    df = spark.createDataFrame([("/a/v/sub/n.md", "sub/n.md"), ("/a/v/n.md", "n.md"), ("/a/v/s/n.md", "s\\n.md")], "a string, r string")
    assert {r[0] for r in df.select(images.root_of(F.col("a"), F.col("r"))).collect()} == {"/a/v"}
