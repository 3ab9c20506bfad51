"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their key that hold about equal
bytes, found from exact byte counts and so the same in every run: ranges of equal
width first, those that hold too much cut again and again.  A shard is
written in key order by one task, which rolls to a new file once the
compressed size passes a limit, regenerates all headers and digests, and gives
a file its final name only when it is complete.  The files of a run are listed
in a manifest, written last; readers open what the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.util import scratch, spread_join, staged

#: A shard holds a 256th of all payload bytes, within these bounds: the data alone decide.
SHARDS, LEAST_BYTES, MOST_BYTES = 256, 4 << 20, 1 << 30
#: Compressed bytes after which a file is closed.
FILE_BYTES = 256 << 20
LEVEL = 1
#: Cells that a range of the key is cut into, and ranges that are cut again on each level; the driver holds a row for
#: each cell.
CELLS, CUT_AGAIN = 1_000, 16
#: Characters of a URI that stay as they are; all others are percent-encoded.
SAFE = "%!#$&'()*+,/:;=?@[]~-._"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "name string, shard bigint, sequence bigint, records bigint, bytes bigint, sha1 string"
NONE = -(1 << 63)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page: int | None, digest: str, n: int) -> str:
    """A name that follows from the record: page, payload and which of equal ones it is."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{n}')}>"


def render(page: int | None, url: str | None, payload: bytes, digest: str, keep: int | None, revisit: bool, n: int) -> bytes:
    """One record with its headers, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest, n)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keep, digest, 0)}"]
        if keep is not None:
            head.append(f"X-Refers-To-Page-Id: {keep}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roll:
    """Writes the files of one shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, most: int):
        self.fs, self.folder = _open(folder)
        self.shard, self.most, self.sequence, self.out = shard, most, 0, None

    def put(self, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.sequence:04d}.warc.gz"
            self.tmp = f"{self.folder}/_tmp/{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.bytes, self.sha1 = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha1()
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha1.update(member)
        self.records += 1
        self.bytes += len(member)
        if self.bytes >= self.most:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.folder}/{self.name}")
            yield self.name, self.shard, self.sequence, self.records, self.bytes, self.sha1.hexdigest()
            self.out, self.sequence = None, self.sequence + 1


def _page(c: Column) -> Column:
    return F.coalesce(c, F.lit(NONE))


def write_warc(pages: DataFrame, folder: str, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write (page_id, url, html) as WARC below ``folder``; the manifest's path.

    A url is written as a URI: what isn't allowed in one, blanks and letters
    beyond ASCII among it, is percent-encoded.  A null html is an empty payload, a null url an empty target, a null page_id
    comes before all others and is left out of the headers.  Of records with
    equal payloads the one with the largest page_id is the response; among
    equal (page_id, payload) rows the first by url is, and the others revisit
    it.  Further columns are ignored.  An empty table gives an empty manifest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(_page(F.col("page_id").cast("long")).alias("page"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keys = staged(rows.select("page", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.octet_length("html").cast("long").alias("size")), "warc-keys")
    total = keys.agg(F.sum(F.col("size") + 1).alias("b")).first()["b"] or 0
    shard_bytes = shard_bytes or min(MOST_BYTES, max(LEAST_BYTES, total // SHARDS))
    shard, shards = _shards(keys, shard_bytes)

    # a digest's largest page is merged before it is shuffled; only rows that revisit another page go on
    largest = keys.groupBy("sha1").agg(F.max("page").alias("keep"), F.count("*").alias("n")).where("n > 1")
    told = spread_join(keys.select("page", "sha1"), largest, ["sha1"], ["page"]).where("page < keep").select("page", "sha1", "keep").distinct()

    # each such row travels just before the pages it is about
    stream = rows.select("page", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.lit(1).alias("kind"), "url", F.encode("html", "UTF-8").alias("html"), F.lit(None).cast("long").alias("keep"))
    note = told.select("page", "sha1", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "keep")
    dealt = stream.unionByName(note).withColumn("shard", shard)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last, keep, n, done = None, None, None, 0, []
        for batch in batches:
            c = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page, sha1, kind, url, payload, note, shard = (x[i].as_py() for x in c)
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        done += roll.close()
                    roll, last = Roll(folder, shard, file_bytes), None
                if (page, sha1) != last:
                    last, keep, n = (page, sha1), None, 0
                if kind == 0:
                    keep = note
                    continue
                name = None if page == NONE else page
                revisit = keep is not None or n > 0
                target = page if keep is None else keep
                done += roll.put(render(name, url, payload, base32(sha1), None if target == NONE else target, revisit, n))
                n += 1
        if roll is not None:
            done += roll.close()
        columns = list(zip(*done)) if done else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, pa.int64()) for x in columns[1:5]), pa.array(columns[5], pa.string())], names=["name", "shard", "sequence", "records", "bytes", "sha1"])

    target, base = _open(folder)
    target.create_dir(f"{base}/_tmp", recursive=True)
    # a shard's number is its task's
    ordered = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page", "sha1", "kind", F.col("url").asc_nulls_first())
    manifest = f"{folder}/manifest-{uuid.uuid4().hex}"
    ordered.mapInArrow(work, MANIFEST).write.parquet(manifest)
    target.delete_dir(f"{base}/_tmp")
    with target.open_output_stream(f"{base}/_COMMITTED.tmp") as f:
        f.write(manifest.encode())
    target.move(f"{base}/_COMMITTED.tmp", f"{base}/_COMMITTED")
    return manifest


def _shards(keys: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """Shard of a row by its page and payload hash, from exact bytes in ranges of the pages, and how many there are.

    The pages' range is cut into CELLS of equal width; the CUT_AGAIN heaviest
    that alone hold more than a shard are cut again, until a cell is one page.
    The driver sees a row for each cell.  What still holds more than a shard is
    split by the payload's hash.
    """
    low, high = keys.where(F.col("page") != NONE).agg(F.min("page"), F.max("page")).first()
    if low is None:
        low = high = 0
    page = F.col("page")
    if high - low >= 1 << 63:
        page, low, high = F.shiftright(page, 1), low >> 1, high >> 1
    listed = lambda xs: F.from_json(F.lit(f"[{','.join(map(str, xs))}]"), "array<bigint>")
    # block and offset of a row on each level; what has no page is a block of its own
    levels, width, blocks = [], high - low + 1, 1
    block = F.when(F.col("page") != NONE, F.lit(0)).cast("long")
    offset = F.when(F.col("page") != NONE, page - F.lit(low)).cast("long")
    weight = [F.sum(F.col("size") + 1).alias("b"), F.count("*").alias("n")]
    none = tuple(keys.where(F.col("page") == NONE).agg(*weight).first())
    while blocks:
        width = -(-width // CELLS)
        cell = (block * CELLS + F.call_function("div", offset, F.lit(width))).cast("int")
        held = {r["cell"]: (r["b"], r["n"]) for r in keys.groupBy(cell.alias("cell")).agg(*weight).collect() if r["cell"] is not None}
        heavy = sorted((c for c, (b, rows) in held.items() if b > shard_bytes and rows > 1), key=lambda c: (-held[c][0], c))[:CUT_AGAIN] if width > 1 else []
        again = {c: i for i, c in enumerate(sorted(heavy))}
        levels.append((held, again, blocks, cell))
        at = listed(again.get(c, "null") for c in range(blocks * CELLS))
        block, offset, blocks = F.get(at, cell), offset % F.lit(width), len(again)

    n, filled = 0, 0
    first = [[0] * (blocks * CELLS) for _, _, blocks, _ in levels]
    split = [[1] * (blocks * CELLS) for _, _, blocks, _ in levels]

    def deal(b: int | None, rows: int) -> tuple[int, int]:
        """First shard and number of shards, no more than rows, of the next ``b`` bytes in order."""
        nonlocal n, filled
        parts = max(1, min(rows, -(-(b or 0) // shard_bytes)))
        if filled and (parts > 1 or filled + b > shard_bytes):
            n, filled = n + 1, 0
        at = n
        if parts > 1:
            n, filled = n + parts, 0
        else:
            filled += b or 0
        return at, parts

    nameless = deal(*none)

    def walk(level: int, block: int) -> None:
        held, again, _, _ = levels[level]
        for c in range(block * CELLS, (block + 1) * CELLS):
            if c in again:
                walk(level + 1, again[c])
            elif c in held:
                first[level][c], split[level][c] = deal(*held[c])

    walk(0, 0)
    shard = F.lit(0)
    for (_, again, _, cell), at, parts in reversed(list(zip(levels, first, split))):
        # a cell that was cut again has no shard of its own
        own = F.get(listed("null" if c in again else x for c, x in enumerate(at)), cell) + F.pmod(F.crc32("sha1"), F.get(listed(parts), cell))
        shard = F.coalesce(own, shard)
    shard = F.when(F.col("page") == NONE, nameless[0] + F.pmod(F.crc32("sha1"), F.lit(nameless[1]))).otherwise(shard)
    return shard.cast("long"), n + 1


def read_warc(spark: SparkSession, manifest: str, payloads: bool = False) -> DataFrame:
    """Records of the files that a manifest lists: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to (and the payload; null for revisits).

    Files are dealt to tasks one by one and read as streams, a record at a time.
    """
    folder = manifest.rsplit("/", 1)[0]
    files = spark.read.schema(MANIFEST).parquet(manifest)
    n = max(1, min(2000, files.count()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for row in records(f"{folder}/{name}"):
                    rows.append(row if payloads else row[:-1])
                    if len(rows) >= (100 if payloads else 5000):
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return files.select("name").repartition(n).mapInArrow(work, ddl)


def records(path: str) -> Iterator[tuple]:
    """Records of one file; digests are checked against the block."""
    target, at = _open(path)
    with target.open_input_stream(at, compression=None) as f:
        z, buffer, out = zlib.decompressobj(31), b"", []
        while True:
            buffer = buffer or f.read(1 << 20)
            if not buffer:
                break
            out.append(z.decompress(buffer))
            buffer = z.unused_data if z.eof else b""
            if z.eof:
                yield parse(b"".join(out))
                z, out = zlib.decompressobj(31), []
        if out and b"".join(out):
            raise ValueError(f"{path} ends inside a record")


def parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    number = lambda k: int(fields[k]) if k in fields else None
    kind = fields["WARC-Type"]
    return number("X-Page-Id"), fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number("X-Refers-To-Page-Id"), payload if kind == "response" else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder))
