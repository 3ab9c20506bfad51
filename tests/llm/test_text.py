"""WARC, main text, shards, secrets, packing and decontamination."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import decontaminate, html_extract, packing, secrets, sharding, util, warc
from textloom.llm.queries import PATTERN, QUERIES, RANKS, SPECIALS
from textloom.llm.util import scratch

# ------------------------------------------------------------------------ WARC

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/é\r\n", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "<p>ü</p>\r\n\r\n"), (None, "u", "<p>x</p>"), (7, "http://e/", "z" * 3_000_000), (7, "http://e/", "z" * 3_000_000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, 0, "x") for p in PAGES], "page_id bigint, url string, html string, shard int, sha1 string")
    folder = scratch(spark, "warc-test")
    manifest = warc.write_warc(df, folder, shard_bytes=1000, file_bytes=50)
    got = warc.read_warc(spark, manifest, payloads=True).collect()
    assert len(got) == len(PAGES)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h in PAGES)
    kinds = {(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got}
    assert (2, sha("<p>x</p>"), "response", None) in kinds and (1, sha("<p>x</p>"), "revisit", 2) in kinds and (None, sha("<p>x</p>"), "revisit", 2) in kinds
    assert (4, sha(""), "response", None) in kinds and (3, sha(""), "revisit", 4) in kinds
    assert Counter(r["record_type"] for r in got if r["page_id"] == 7) == {"response": 1, "revisit": 1}
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in PAGES}
    # the same rows give the same files, whatever their order and partitions
    listed = lambda m: {tuple(r) for r in spark.read.schema(warc.MANIFEST).parquet(m).select("name", "records", "bytes", "sha1").collect()}
    again = warc.write_warc(df.orderBy(F.desc("page_id")).repartition(5), scratch(spark, "warc-test"), shard_bytes=1000, file_bytes=50)
    assert listed(manifest) == listed(again) and len(listed(manifest)) > 3


def test_ranges_with_an_outlier_are_cut_again(spark):
    """One far page does not put all others in one shard; shards are in the order of the pages."""
    ids = [*range(1, 3001), 1 << 62, -(1 << 62), None]
    keys = spark.createDataFrame([(warc.NONE if i is None else i, hashlib.sha1(str(i).encode()).hexdigest(), 99) for i in ids], "page bigint, sha1 string, size bigint")
    shard, n = warc._shards(keys, 10_000)
    got = keys.select("page", shard.alias("s")).collect()
    each = Counter(r["s"] for r in got)
    assert max(each) < n and max(each.values()) <= 101 and len(each) >= 30
    ordered = [r["s"] for r in sorted(got) if r["page"] != warc.NONE]
    assert ordered == sorted(ordered)


def test_urls_are_percent_encoded(spark):
    df = spark.createDataFrame([(1, "http://x.org/é b\r\n?q=%20&a=[1]", "h")], "page_id bigint, url string, html string")
    assert warc.round_trip(df).first()["url"] == "http://x.org/%C3%A9%20b%0D%0A?q=%20&a=[1]"


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(df).collect() == []


# ------------------------------------------------------------------- main text

MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav>"
PAGE = f"""<!doctype html><html><head><title>No</title><style>p {{}}</style></head><body>{MENU}<header>Site</header>
<main><h1>The&nbsp;title</h1><p>One  two\n three &amp; <b>fo</b>ur.</p><script>var x = '<p>no</p>';</script>
<aside>Advert</aside><p>Second <!-- no --> paragraph &lt;here&gt;.</p><form><label>Mail</label></form></main>
<section class="comments"><p>I disagree with all of it.</p></section><footer>Imprint</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p></p>"), (4, PAGE.replace("three", "three " * 50_000))]
    df = spark.createDataFrame([(i, h, "t", 5) for i, h in rows], "page_id bigint, html string, text string, n_chars int")
    got = html_extract.extract(df, ["page_id"]).collect()
    text = "The title One two three & four. Second paragraph <here>."
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert by[1] == [text, text] and by[2] == [""] and by[3] == [""] and by[None] == [""]
    assert by[4] == [text.replace("three", " ".join(["three"] * 50_000))]
    assert html_extract.extract(df.limit(0), ["page_id"]).collect() == []


W = {("word", "article"): 2.0, ("word", "main"): 2.0, ("word", "body"): -1.0, ("word", "div"): -0.5}
WORDS = "Some words of the text of this page that are enough for a run. " * 4


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='no-sidebar'", "div class='wrapper nav-open'", "div class='page-header-fixed'", "div id='post has-comments'", "form action='/x'", "div class='search'", "main class='content has-sidebar'", "main><div class='no-sidebar'"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_on_ancestors_keep_the_article(wrapper, tag):
    page = f"<body>{MENU}<{wrapper}><div><{tag}><p>{WORDS}</p><aside>Advert</aside></{tag}></div></{wrapper.split()[0].split('>')[0]}></body>"
    assert html_extract.main_text(page, W) == " ".join(WORDS.split())
    assert html_extract.main_text(page.replace(f"<{tag}>", f"<{tag} hidden>"), W) == ""


def test_the_run_keeps_all_elements_it_covers():
    text = lambda p: html_extract.main_text(f"<body>{MENU}{p}<footer>Imprint</footer></body>", W)
    body = " ".join(WORDS.split())
    assert text(f"<main><p>intro</p><article><p>{WORDS}</p></article><p>after</p></main>") == f"intro {body} after"
    assert text(f"<article><p>{WORDS}</p></article><p>between</p><article><p>{WORDS} second</p></article>") == f"{body} between {body} second"
    related = f"<main><article>{WORDS}</article><aside><article>{WORDS}</article></aside></main>"
    assert text(related) == body
    comments = f"<main><article>{WORDS}</article><div class='comments'><article>{WORDS}</article></div></main>"
    assert text(comments) == body
    # a teaser in an element does not take the place of a run that lies elsewhere
    w = W | {("word", "section"): 2.0}
    got = html_extract.main_text(f"<body><section>{WORDS}<article>Teaser</article>{WORDS}</section></body>", w)
    assert got == f"{body} Teaser {body}"


def test_best_run_is_the_best():
    """The linear scan finds what trying every run finds."""
    r = random.Random(2)
    for _ in range(200):
        parts = []
        for _ in range(r.randint(1, 8)):
            n = html_extract.Node("w " * r.randint(0, 4), r.choice("ab"), r.random() < 0.3, 0, [r.choice("pq")] * r.randint(0, 2), True)
            parts.append(n)
        w = {("word", "a"): 1.5, ("word", "b"): -0.7, ("tag", "p"): -0.3, ("tag", "q"): -1.1}
        value = lambda a, b: sum(sum(w["tag", t] for t in p.tags) * (i > 0) + p.words * (-2.0 if p.out else w["word", p.key]) for i, p in enumerate(parts[a:b]))  # noqa: B023, E731
        most = max([0.0, *(value(a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1))])
        a, b = html_extract.best_run(parts, w)
        tags = sum(w["tag", t] for t in parts[a].tags) if b > a else 0
        assert value(a, b) + tags <= most + 1e-9 and value(a, b) >= most - 2 * 1.1 - 1e-9


PROBES = {
    '<article><div title="the hidden gem"><p>one two three four</p></div></article>': "one two three four",
    "<article><p>one two three</p><button>Go<p>four five six</p></article>": "one two three four five six",
    "<article><p>one two three</p><select><option>Go<p>four five six</p></article>": "one two three four five six",
    "<article><p>one two three</p><svg/>four five six</article>": "one two three four five six",
    '<article class="search"><p>alpha beta gamma</p></article>': "alpha beta gamma",
    "<article><span class=ad><span>buy</span> this</span> alpha beta gamma</article>": "alpha beta gamma",
    "<article>alpha beta <script>var x = '<p>'</article>": "alpha beta",
    "<article>alpha 1 < 2 beta <!-- gone --> gamma <a title='a > b'>delta</a></article>": "alpha 1 < 2 beta gamma delta",
    "<article>alpha beta gamma <article class='comment'>never</article></article>": "alpha beta gamma",
    "<body><nav>Home News</nav><div class='content'><p>alpha beta gamma</p><p>delta epsilon</p></div><footer>Imprint</footer></body>": "alpha beta gamma delta epsilon",
    "<h1>alpha beta</h1><p>gamma &eacute; delta": "alpha beta gamma \u00e9 delta",
}


@pytest.mark.parametrize("page", PROBES)
def test_odd_pages(page):
    """Broken markup, names in attributes, and pages that name no article, under weights of other pages."""
    assert html_extract.main_text(page, W) == PROBES[page]


@pytest.mark.parametrize("broken", ["<a x ", '<a "', '<a x="', "<article>", '<b ">', "</div>", "<script>", "<div class=x>", "<!--", "<", "<p '>\"", "<svg>"])
def test_broken_markup_is_read_in_linear_time(broken):
    begin = time.process_time()
    html_extract.main_text(broken * 100_000, W)
    assert time.process_time() - begin < 5


# ---------------------------------------------------------------------- shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


def test_shards(spark):
    rows = [(i % 700, "x" * (i % 5)) for i in range(1000)] + [(None, "n"), (None, "n"), (None, None)] + [(9, "hot")] * 500
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, v string, shard int, row_number int")
    got = sharding.feistel_shards(df, "doc_id", 16).collect()
    assert Counter((r["doc_id"], r["v"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.feistel_shards(df.repartition(3), "doc_id", 16).collect()
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in again)
    assert sharding.feistel_shards(df.limit(0), "doc_id", 4).collect() == []
    with pytest.raises(ValueError):
        sharding.feistel_shards(df, "doc_id", 0)


def test_shard_query(spark):
    got = QUERIES["op4_feistel_shards"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)


# --------------------------------------------------------------------- secrets

BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def as_text(spans):
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)


EDGES = [None, "", "password: abc", "PASSWORD = 'hunter22'", 'api_key:"token=abcdef12"', "é\U0001f600 secret=deadbeefdeadbeefdeadbeef0", "AKIA" + "A1" * 8 + " AKIAX AKIAAKIA" + "B" * 12, "token=aaaaaa token=aaaaaa", "x" * 500_000 + " passwd:zzzzzzzz", "tokentoken==aaaaaaa", "secret secret: secret=secret1"]


def test_base_spans(spark):
    r = random.Random(4)
    bits = ["password", "Secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\U0001f600", "\n"]
    texts = EDGES + ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "s", "c") for i, t in enumerate(texts)], "doc_id bigint, text string, secrets string, candidates string")
    got = secrets.digest(secrets.owned_secrets(df, F.lit("o"), F.lit("r"))).collect()
    assert len(got) == len(texts)
    for row in got:
        want = brute_base(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(as_text(want).encode()).hexdigest(), texts[row["doc_id"]]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, as_text(want).split(","))) <= set(row["spans"].split(","))


def test_secrets_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = QUERIES["op5_secrets"](spark, MEDIUM).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(as_text(brute_base(t)).encode()).hexdigest() for i, t in texts.items()}


def test_ownership_classes(spark):
    live, copied = "token=Zx81kQp0Lm3Rt7Ws", "token=Ab12Cd34Ef56Gh78"
    rows = [(1, f"a {live}", "o1"), (2, f"b {live}", "o1"), *((i, copied, f"o{i}") for i in range(3, 8)), (9, "token=aaaaaaaaaaaa", "o1"), (10, "plain", None)]
    found = {r["doc_id"]: r for r in secrets.redact(secrets.owned_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), F.col("source"), F.col("source"))).collect()}
    assert found[1]["secrets"][0]["class"] == "live" and found[1]["secrets"][0]["uses"] == 2 and found[1]["text"] == "a token=[SECRET]"
    assert found[3]["secrets"][0]["class"] == "example" and found[3]["secrets"][0]["owners"] == 5 and found[3]["text"] == copied
    assert found[9]["secrets"][0]["class"] == "review" and found[10]["text"] == "plain" and found[10]["secrets"] == []
    assert secrets.owned_secrets(spark.createDataFrame([], "text string"), F.lit(1), F.lit(1)).collect() == []
    rows = [(o, f"{o}/{k}", live) for o in ("p", "q") for k in range(3)] + [("r", "r/0", copied), ("s", "s/0", copied)]
    found = secrets.owned_secrets(spark.createDataFrame(rows, "o string, r string, text string"), F.col("o"), F.col("r")).collect()
    assert {(r["text"], r["secrets"][0]["class"], r["secrets"][0]["repositories"]) for r in found} == {(live, "example", 6), (copied, "review", 2)}


def test_many_matches_in_one_text_and_one_value_in_many_texts(spark, monkeypatch):
    """Places come in one pass; a value that most rows have is dealt to salts."""
    monkeypatch.setattr(util, "HOT_ROWS", 3)
    long = "".join(f"é token=secretvalue{i:07d} " for i in range(20_000))
    df = spark.createDataFrame([(0, long)] + [(i, "x password=samesame1234") for i in range(1, 40)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.owned_secrets(df, F.lit("o"), F.lit("r"))).collect()}
    assert len(got) == 40 and all(r["n_assign"] == 1 and r["secrets"][0]["uses"] == 39 for i, r in got.items() if i)
    assert got[0]["base_sha256"] == hashlib.sha256(as_text(brute_base(long)).encode()).hexdigest()


# --------------------------------------------------------------------- packing


def twins():
    """Two words of 1,024 letters, unlike in every place, that sums of powers modulo 2^64 can't tell apart."""
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return [first, first.translate({97: "b", 98: "a"})]


def test_words_built_to_collide_hash_apart():
    column = pa.array([*twins(), *("x y " + t for t in twins())])
    h = util.word_hashes(*util.text_bytes(column))[0]
    assert len(set(h.tolist())) == 4


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts, most_padding=None):
    """The pieces are the texts' ids, each once, and sequences hold them without gaps."""
    ids = {k: [*x.ids, 0] for k, x in zip(texts, tokenizer().encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            piece = ids[k][at : at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += r["length"]
        assert at == len(ids[k])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    if most_padding:
        assert sum(r["length"] for r in rows) >= (1 - most_padding) * 1024 * len(sequences)


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: " two  blanks ", 4: "a\n \nb\t c 's 123 <|endoftext|>", 5: "word " * 5000, 6: "中文é  x", 7: "x" * 20_000}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id bigint, text string, start int, length int")
    check_packing(packing.pack_documents(df, RANKS, PATTERN, specials=SPECIALS).collect(), texts)
    assert packing.pack_documents(df.limit(0), RANKS, PATTERN).collect() == []
    twice = packing.pack_documents(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string"), RANKS, PATTERN, with_ids=True).collect()
    assert [r["doc_id"] for r in twice] == [None, None] and all(r["ids"][-1] == 0 for r in twice)


def test_packing_of_blanks_beside_other_white_space(spark):
    r = random.Random(8)
    bits = [" ", " ", "\u00a0", "\u00a0", "\n", "\t", "\x1c", "\x85", "\u2003", "\u3000", "\u202f", "\u2028", "foo", "bar", "é", "中", "\u2014", "\u201cx\u201d", "\u00e0", "'s", "12"]
    texts = dict(enumerate(["foo \u00a0 \u00a0 bar", " \u00a0 \u00a0\u00a0 foo", "a \u00a0", "\u00a0 \u00a0 \u00a0 \u00a0", "foo\u00a0 \u00a0bar"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(3000)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_packing(packing.pack_documents(df, RANKS, PATTERN, specials=SPECIALS).collect(), texts)


def test_packing_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    check_packing(QUERIES["op6_packing"](spark, MEDIUM).collect(), texts, 0.05)


def test_classes_hold_their_count():
    for n in range(1, 5000, 7):
        cut = packing.cuts(n, 1024, 16, 0.96)
        assert sum(x for x, _ in cut) == n and all(x <= 1024 // k for x, k in cut if k <= 16)


# ------------------------------------------------------------- decontamination


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    items = {i: words(40) for i in range(20)} | {20: words(6), 21: [], 22: None}
    noise = {i: words(200) for i in range(100, 130)}
    docs, planted = {}, set()
    for i, item in list(items.items())[:20]:
        w = list(item)
        for at in range(4 + i % 5, 40, 9 + i % 4):  # a substituted word every nine to twelve
            w[at] = word()
        docs[i] = " ".join([*words(30), *(x.upper() if i % 2 else x for x in w), *words(30)])
        planted.add((i, i))
    docs |= {i: " ".join(w) for i, w in noise.items()} | {50: None, 51: "", 52: " ".join([*words(10), *items[20], *words(4)]), 53: " ".join(items[3][:5] + words(100))}
    planted.add((52, 20))
    df = spark.createDataFrame([(k, t, 0) for k, t in docs.items()], "doc_id bigint, text string, item int")
    bench = spark.createDataFrame([(k, w and " ".join(w), 0) for k, w in items.items()], "item_id bigint, text string, doc int")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, bench).collect()}
    assert got == planted
    assert decontaminate.contaminated(df.limit(0), bench).collect() == [] and decontaminate.contaminated(df, bench.limit(0)).collect() == []


def has_seed(match):
    """Whether a seed lies on matching words alone."""
    b = np.arange(1, len(match) + 1, dtype=np.uint64)
    d = np.where(match, b, b + np.uint64(1000))
    one = np.zeros(len(b), np.int64)
    return any((decontaminate.seed_hashes(b, one, m)[0] == decontaminate.seed_hashes(d, one, m)[0]).any() for m in decontaminate.masks_of(len(b)))


def accepted(match):
    return decontaminate.best_stretch(match)[0] >= min(decontaminate.LEAST_WORDS, -(-4 * len(match) // 5))


def test_every_accepted_overlap_has_a_seed():
    """All patterns of short items; of longer ones, all with few substitutions and many with more."""
    for n in range(1, 21):
        least = 0
        for k in range(n + 1 if n < 15 else 6):
            for free in itertools.combinations(range(n), k):
                match = np.ones(n, bool)
                match[list(free)] = False
                if accepted(match):
                    least += 1
                    assert has_seed(match), match.astype(int)
        assert least
    r = np.random.default_rng(5)
    for n in (25, 30, 45, 59):
        for _ in range(3000):
            match = r.random(n) > r.uniform(0.15, 0.35)
            assert has_seed(match) or not accepted(match), match.astype(int)


def test_substituted_short_items_are_found(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 19)}
    subs = {n: [k] for n, k in ((5, 0), (6, 0), (7, 3), (8, 3), (9, 4), (10, 5), (11, 4), (12, 5), (13, 6), (14, 6))} | {15: [4, 9], 16: [3, 7, 11], 18: [3, 7, 11, 14]}
    docs = {n: ["a"] * 20 + ["other" if i in subs.get(n, []) else w for i, w in enumerate(x)] + ["b"] * 20 for n, x in items.items()}
    want = {(n, n) for n, x in items.items() if accepted(np.array([i not in subs.get(n, []) for i in range(n)]))}
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in docs.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, bench).collect()} == want and len(want) > 8


def test_decontamination_finds_whole_passages(spark):
    """What holds an item's first fifty words, word for word, is found."""
    norm = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    docs = {r["doc_id"]: norm(r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x and f" {x} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, MEDIUM).collect()}
    assert exact and exact <= got
