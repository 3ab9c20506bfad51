"""Operators on small literal inputs."""

from __future__ import annotations

import io
import math
import os
import random
import struct
import zipfile

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from textloom import providers
from textloom.catalog import QUERIES
from textloom.functions import paths, text
from textloom.operators import bm25, chunk, fuse, knn, maintain, reconcile, records
from textloom.sources import archive, parsers, scan
from textloom.streaming import jobs
from textloom.tables import Table


def value(spark, column, **inputs):
    """A column's value on one row of string inputs."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column).first()[0]


# ---------------------------------------------------------------------- chunks


def test_hard_windows():
    assert all(len(p.text) <= 200 for p in chunk.split_plain("a" * 1000, 200, False)) and len(chunk.split_plain("a" * 1000, 200, False)) >= 5
    assert [p.text for p in chunk.split_plain("abc", 1)] == ["a", "b", "c"]
    assert [p.text for p in chunk.split_plain("a" * 800, 800)] == ["a" * 800]


def test_sentences_stay_in_bounds():
    body = "段落一。" * 100 + "\n\n" + "段落二。" * 100
    for p in chunk.split_plain(body, 400):
        assert 0 <= p.start < p.end <= len(body) and len(p.text) <= 400 + 60 + 2


def test_markdown_tables_repeat_their_head():
    rows = "\n".join(f"| {i} | value {i} |" for i in range(20))
    pieces = chunk.split_table(f"| a | b |\n| --- | --- |\n{rows}\n", 80)
    assert len(pieces) >= 2 and all(p.text.startswith("| a | b |\n| --- | --- |") for p in pieces)


def test_chunks_of_formats(spark):
    md = "intro\n# A\nalpha\n### B\nbeta\n## C\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n"
    html = "<h1>Top</h1><p>one</p><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>b</td></tr></table>"
    df = spark.createDataFrame([(1, md, "markdown"), (2, html, "html"), (3, "", "text"), (4, None, "text"), (5, "plain", "text")], "id bigint, body string, format string")
    got = chunk.chunks(df, "body", F.col("format"), ["id"]).collect()
    crumbs = [r["breadcrumb"] for r in got if r["id"] == 1]
    assert crumbs == [None, "A", "A > B", "A > C"]
    pages = [r["text"] for r in got if r["id"] == 2]
    assert pages and "<" not in "".join(pages) and any("| a | b |" in p for p in pages)
    assert not [r for r in got if r["id"] in (3, 4)] and [r["text"] for r in got if r["id"] == 5] == ["plain"]


# ------------------------------------------------------------------- functions


@pytest.mark.parametrize("query,terms", [("What is RRF and how to use it?", ["rrf"]), ("the of and", [])])
def test_query_terms(spark, query, terms):
    got = value(spark, text.query_terms(F.col("q")), q=query)
    assert (got or []) == terms


@pytest.mark.parametrize("pattern,path,hit", [("*.md", "a.md", True), ("private/**", "private/x/y.md", True), ("private/**", "public/x.md", False), ("?.txt", "a.txt", True), ("?.txt", "ab.txt", False), ("[ab].txt", "b.txt", True), ("a+b.md", "a+b.md", True), ("a+b.md", "aab.md", False)])
def test_globs(spark, pattern, path, hit):
    assert value(spark, paths.matches_any(F.col("p"), [pattern]), p=path) is hit


def test_filters(spark):
    rows = [("note.md", 10), ("private/secret.md", 10), ("ignored.txt", 10), ("large.md", 100)]
    df = spark.createDataFrame(rows, "p string, n bigint")
    got = df.where(paths.wanted(F.col("p"), F.col("n"), exclude=["private/**"], exts=["md"], max_size=64)).collect()
    assert [r["p"] for r in got] == ["note.md"]


# ------------------------------------------------------------------- retrieval


def test_bm25_against_brute_force(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("red green blue amber violet teal".split()) for _ in range(r.randint(1, 12)))) for i in range(60)] + [(100, None), (101, "")]
    d = spark.createDataFrame(docs, "id bigint, body string")
    q = spark.createDataFrame([(1, "red teal"), (2, "violet"), (3, "absent"), (4, None)], "query_id bigint, query string")
    got = bm25.search(d, "id", {"content": F.col("body")}, q, "query_id", "query", 5).collect()
    token = {i: (t or "").split() for i, t in docs}
    n, mean = len(token), sum(map(len, token.values())) / len(token)
    for query, words in ((1, ["red", "teal"]), (2, ["violet"])):
        scores = {}
        for i, ws in token.items():
            s = 0.0
            for w in words:
                df = sum(w in x for x in token.values())
                idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
                tf = ws.count(w)
                s += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ws) / mean)) if tf else 0
            if any(w in ws for w in words):
                scores[i] = s
        own = [x for x in got if x["query_id"] == query]
        assert len(own) == min(5, len(scores)) and all(x["id"] in scores for x in own)
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1)) or sorted(x["rank"] for x in own) == list(range(1, len(own) + 1))
    assert not [x for x in got if x["query_id"] in (3, 4)]


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(2)
    x, q = r.normal(size=(300, 8)).astype(np.float32), r.normal(size=(5, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    s = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(q)], "query_id bigint, query_vector array<float>")
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    got = knn.exact(v, s, 7, -1.0).collect()
    for i in range(5):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == np.argsort(-cos[i])[:7].tolist()
    near = {(r["query_id"], r["vec_id"]) for r in knn.approximate(v, s, 7, 8, 40, 3).collect()}
    want = {(i, j) for i in range(5) for j in np.argsort(-cos[i])[:7].tolist()}
    assert len(near & want) >= 0.9 * len(want)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM, "/root/testdata/sf0.1"])
def test_approximate_recall(spark, folder):
    """The registered query finds nine tenths of the exact neighbours, over the whole table, with their scores."""
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in QUERIES["knn_exact"](spark, folder).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in QUERIES["knn_lsh"](spark, folder).collect()}
    both = set(want) & set(got)
    print(folder, "recall", len(both) / len(want))
    assert len(both) >= 0.9 * len(want) and all(abs(want[x] - got[x]) < 2e-6 for x in both)


def test_rank_fusion(spark):
    schema = "query_id bigint, key string, rank int, score double"
    vector = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], schema)
    lexical = spark.createDataFrame([(1, "b", 1, -0.8), (1, "c", 2, -0.7)], schema)
    got = sorted(fuse.hybrid(vector, lexical, "query_id", "key", 2).collect(), key=lambda r: r["rank"])
    assert [(r["key"], r["fusion_score"]) for r in got] == [("b", round(1 / 62 + 1 / 61, 6)), ("a", round(1 / 61, 6))]
    assert fuse.pool_size(2) == 20 and fuse.pool_size(10) == 40 and fuse.pool_size(50) == 100
    with pytest.raises(ValueError):
        fuse.pool_size(1, low=5, high=4)


class Fixed:
    def __init__(self, answer):
        self.answer = answer

    def rerank(self, query, documents, top_n):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


@pytest.mark.parametrize("answer,keys,scored", [([(2, 0.99), (0, 0.73)], ["c", "a"], True), ([(0, 0.5), (0, 0.6)], ["a", "b"], False), ([(9, 0.5)], ["a", "b"], False), ([(0, 1.5)], ["a", "b"], False), ([], ["a", "b"], False), (RuntimeError("down"), ["a", "b"], False)])
def test_rerank(spark, answer, keys, scored):
    hits = spark.createDataFrame([(1, "a", 1, "q", "x"), (1, "b", 2, "q", "y"), (1, "c", 3, "q", "z")], "query_id bigint, key string, rank int, query string, doc string")
    got = sorted(fuse.rerank(hits, "query_id", "key", "query", "doc", Fixed(answer), 2).collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in got] == keys and all((r["rerank_score"] is not None) == scored for r in got)


def test_scopes_are_merged_by_rank(spark):
    hits = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 2), (1, 2, "z", 1)], "query_id bigint, scope int, key string, rank int")
    got = sorted(fuse.across_scopes(hits, "query_id", "scope", "key", 2).collect(), key=lambda r: r["rank"])
    assert [(r["scope"], r["key"], r["fusion_score"]) for r in got] == [(1, "x", round(1 / 61, 6)), (2, "z", round(1 / 61, 6))]


def test_chat_events(spark):
    hits = spark.createDataFrame([(1, "a")], "query_id bigint, key string")
    events = list(fuse.drain(hits, providers.EchoGenerator(), [{"role": "user", "content": "hello"}]))
    assert events[0]["event"] == "sources" and events[-1]["event"] == "done"


# -------------------------------------------------------------- reconciliation

FILE = "rel_path string, size_bytes bigint, mtime_ns bigint, content_hash string"


def test_plan(spark):
    seen = [("same", 1, 1, "s"), ("touched", 1, 2, "t"), ("changed", 2, 2, "new"), ("fresh", 1, 1, "f"), ("to", 5, 5, "m"), ("d1", 1, 1, "dup"), ("e2", 1, 1, "")]
    known = [("same", 1, 1, "s"), ("touched", 1, 1, "t"), ("changed", 2, 1, "old"), ("gone", 1, 1, "g"), ("from", 5, 4, "m"), ("d2", 1, 1, "dup"), ("d3", 1, 1, "dup"), ("e1", 1, 1, "")]
    planned = reconcile.plan(spark.createDataFrame(seen, FILE), spark.createDataFrame(known, FILE))
    got = {tuple(r) for r in planned.select("action", "old_path", "new_path").collect()}
    assert got == {("unchanged", "same", "same"), ("unchanged", "touched", "touched"), ("update", "changed", "changed"), ("add", None, "fresh"), ("delete", "gone", None), ("move", "from", "to"), ("add", None, "d1"), ("delete", "d2", None), ("delete", "d3", None), ("add", None, "e2"), ("delete", "e1", None)}
    need = reconcile.need_hash(spark.createDataFrame(seen, FILE), spark.createDataFrame(known, FILE))
    assert "same" not in {r["rel_path"] for r in need.collect()} and need.count() == 6


@pytest.mark.parametrize("known,deletes,force,prune,complete,why", [(10, 5, False, True, True, None), (10, 6, False, True, True, "over_ratio"), (10, 6, True, True, True, None), (10, 6, False, False, False, "prune_disabled"), (10, 1, False, True, False, "scan_incomplete"), (0, 0, False, True, True, None)])
def test_guard(spark, known, deletes, force, prune, complete, why):
    assert value(spark, reconcile.blocked(*map(F.lit, (known, deletes, force, prune, complete)))) == why


def test_doctor(spark):
    vectors = spark.createDataFrame([("v1",), ("ghost",)], "vector_id string")
    chunks_ = spark.createDataFrame([("v1", 1), ("v2", 1)], "vector_id string, note_id bigint")
    notes = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, file_path string")
    assert tuple(reconcile.doctor(vectors, chunks_, notes).first()) == (1, 1, 1, False)
    assert [r[0] for r in reconcile.repair(vectors, chunks_).collect()] == ["v1"]


def test_moves_keep_what_is_indexed(spark):
    notes = spark.createDataFrame([(1, 7, "old.md", "T"), (2, 7, "b.md", "B")], "id bigint, vault_id bigint, file_path string, title string")
    got = maintain.move_files(notes, spark.createDataFrame([(7, "old.md", "new/x.md")], "vault_id bigint, old_path string, new_path string"))
    assert {tuple(r) for r in got.select("id", "file_path", "title").collect()} == {(1, "new/x.md", "T"), (2, "b.md", "B")}


# --------------------------------------------------------------------- records


def test_retention_keeps_active_runs(spark):
    runs = [(i, 1, "success", i) for i in range(60)] + [(100, 1, "running", -5), (101, 2, "failed", 0)]
    df = spark.createDataFrame(runs, "id bigint, vault_id bigint, status string, started_at bigint")
    kept = {r["id"] for r in records.retained(df, "vault_id", "id", "status", "started_at").collect()}
    assert {100, 101} <= kept and len(kept) in (51, 52) and 0 not in kept and 59 in kept


def test_stored_tables(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "id bigint, v string")
    assert t.read().count() == 0
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, v string"))
    t.insert_absent(spark.createDataFrame([(1, "no"), (4, "e")], "id bigint, v string"))
    t.patch(spark.createDataFrame([(1, None), (3, "z")], "id bigint, v string"), ["v"])
    t.delete(F.col("id") == 4)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "z")}


# --------------------------------------------------------------------- sources


def test_scan(spark, tmp_path):
    for name, size in (("note.md", 5), ("private/secret.md", 5), (".git/hidden.md", 5), ("ignored.txt", 5), ("sub/large.md", 100)):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    files, complete = scan.scan(spark, str(tmp_path), exclude=["private/**"], exts=["md"], max_size=64)
    assert [r["rel_path"] for r in files.collect()] == ["note.md"] and complete.first()["scan_complete"]
    assert files.first()["mtime_ns"] == os.stat(tmp_path / "note.md").st_mtime_ns
    with pytest.raises(Exception, match="unavailable"):
        scan.scan(spark, str(tmp_path / "none"))[0].collect()


def book(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_parsers(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p></w:body></w:document>')
    files = [("a.md", b"# T\nx"), ("b.TXT", b"bad \xff byte"), ("c.xlsx", bytearray(book({"S": [["h1", "h2"], ["a|b"], [""]], "E": []}))), ("d.docx", bytearray(docx.getvalue())), ("e.docx", b"not a zip"), ("f.bin", b"?"), ("g.pdf", b"%PDF")]
    got = {r["rel_path"]: r for r in parsers.parse(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "rel_path string, content binary")).collect()}
    assert "f.bin" not in got and got["a.md"]["content"] == "# T\nx" and got["a.md"]["title"] == "a" and got["b.TXT"]["content"] == "bad � byte"
    assert got["c.xlsx"]["content"] == "# S\n\n| h1 | h2 |\n| --- | --- |\n| a\\|b |  |" and "E" in got["c.xlsx"]["meta"]["sheets"]
    assert "# Head" in got["d.docx"]["content"] and "Body text" in got["d.docx"]["content"]
    assert got["e.docx"]["error"] and got["g.pdf"]["error"]


def test_images():
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\0" * 8
    assert parsers.image_size(png(400, 300)) == ("image/png", 400, 300)
    assert parsers.admissible(png(400, 300)) and not parsers.admissible(png(50, 50)) and not parsers.admissible(b"?")


def test_archives(tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a/b.md", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil.md", "x")
    archive.unpack(str(good), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.md").read_text() == "x"
    with pytest.raises(Exception):
        archive.unpack(str(bad), str(tmp_path / "out2"))
    assert not (tmp_path / "evil.md").exists()


# --------------------------------------------------------------------- streams


def test_debounced_stream(spark, tmp_path):
    rows = [("a.md", f"2024-01-01 00:00:0{s}") for s in (0, 0, 3)] + [("b.md", "2024-01-01 00:00:01"), ("z", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "path string, t string").select("path", F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "path string, ts timestamp")
    q = jobs.debounce(stream, "path", late="1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r["path"], r["changes"]) for r in spark.table("bursts").collect()) == [("a.md", 1), ("a.md", 2), ("b.md", 1)]
    batch = jobs.debounce(df, "path", late=None)
    assert sorted((r["path"], r["changes"]) for r in batch.collect()) == [("a.md", 1), ("a.md", 2), ("b.md", 1), ("z", 1)]


def test_packs_are_the_longest_ranges_that_fit():
    rnd = random.Random(3)
    for _ in range(300):
        sizes = [rnd.randint(1, 9) for _ in range(rnd.randint(0, 12))]
        room, gap, tail = rnd.randint(1, 20), rnd.randint(0, 2), rnd.randint(0, 4)
        found = list(chunk.packs(sizes, room, gap, tail))
        assert [k for i, j in found for k in range(i, j)] == list(range(len(sizes)))
        carried = 0
        for i, j in found:
            size = lambda end, i=i, carried=carried: carried + sum(sizes[i:end]) + gap * (end - i - 1)
            assert j == i + 1 or size(j) <= room
            assert j == len(sizes) or size(j + 1) > room
            carried = min(tail, size(j)) + gap if tail else 0


def test_tables_are_cut_between_rows_below_their_head():
    table = "|a|\n|-|\n" + "".join(f"|{k}|\n" for k in range(10))
    pieces = chunk.split_table(table[:-1], 16, 100)
    assert [p.text for p in pieces] == ["|a|\n|-|\n" + f"|{k}|\n|{k + 1}|" for k in range(0, 10, 2)]
    assert [p.start for p in pieces] == [100, 116, 124, 132, 140]
