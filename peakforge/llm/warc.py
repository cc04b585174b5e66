"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record into files of the shared folder, a new file per task attempt, and
returns where each record lies. ``build_index`` sorts the captures by reversed-host URL key and writes them as
compressed blocks of ``lines`` lines with, for each shard of the range of (key, page_id), a sparse directory of the
blocks' first places. ``lookup`` finds the shard and the block by binary search and reads that block alone; ``read_records`` then makes
range reads in file order. Only one row per shard reaches the driver.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, salted_join

SHORT = 100  # payloads of fewer bytes never become revisits
FILE_BYTES = 512 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
#: Digests of payloads that come twice are broadcast up to this number (about 10 MB); more are joined by a shuffle.
BROADCAST_FIRSTS = 100_000


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels reversed, A-Z lower-cased; a URL without ``://`` stays as it is."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), key).otherwise(url), F.lit(""))


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_bytes(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response, or (``payload`` None) a revisit that keeps the HTTP header of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    refers_to: int | None
    payload_bytes: int
    digest: str
    payload: bytes | None


def parse_record(data: bytes) -> Record:
    """A record from its bytes. A response's digest is computed from the payload, a revisit's is the one it declares."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)content-length: (\d+)", http)[1])

    def number(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "revisit":
        return Record(kind, number("WARC-Record-ID"), number("WARC-Refers-To"), declared, stated, None)
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated or declared != len(payload):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload is not the one that was written")
    return Record(kind, number("WARC-Record-ID"), None, len(payload), digest, payload)


_CAPTURES = "key string, page_id long, kind string, file string, at long, size long"


def _schema(*fields) -> pa.Schema:
    return pa.schema(list(fields))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", short: int = SHORT) -> DataFrame:
    """Write a record per row; returns (key, page_id, kind, file, at, size) of each. Run it once, through ``materialize``.

    Null html is an empty payload. Of equal payloads of ``short`` bytes or more the smallest page_id is the response, with
    all rows of that id; the others revisit it. Rows without page_id come last.
    """
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    base = base.withColumns({"digest": F.sha2("body", 256), "n": F.octet_length("body").cast("long")})
    known = base.filter(F.col("n") >= short).select("digest", "page_id")
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("digest", "first")
    firsts = materialize(firsts, "firsts")
    long = base.filter(F.col("n") >= short)
    # Bodies stay where they are if few payloads come twice.
    marked = long.join(F.broadcast(firsts), "digest", "left") if firsts.count() <= BROADCAST_FIRSTS else salted_join(long, firsts, "digest", "page_id", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "body", "n", "digest", "first"]
    marked = marked.withColumns({"body": F.when(~again, F.col("body")), "first": F.when(again, F.col("first"))}).select(*columns)
    marked = marked.unionByName(base.filter(F.col("n") < short).withColumn("first", F.lit(None).cast("long")).select(*columns))
    marked = marked.withColumn("key", url_key(F.col("url")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = None, None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # no two attempts share a file
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = _gz(record_bytes(r["page_id"], r["url"], r["body"], r["n"], r["digest"], r["first"]))
                out.write(data)
                rows.append((r["key"], r["page_id"], "response" if r["body"] is not None else "revisit", name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "kind", "file", "at", "size"])
        if out is not None:
            out.close()

    return marked.mapInArrow(write, _CAPTURES)


Place = tuple[str, bool, int]  # key, whether there is a page_id, page_id: the order of captures


def _place(key: str, page_id: int | None) -> Place:
    return (key, page_id is not None, page_id or 0)


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """By range into as many parts as shuffles have, which are not merged though rows are small: each row means a read."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)


@dataclass
class CaptureIndex:
    folder: str
    shards: list[tuple[Place, str]]  # first place, name; sorted


def build_index(captures: DataFrame, folder: str, lines: int = 2000) -> CaptureIndex:
    """Blocks and directories of all captures, sharded by ranges of (key, page_id)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, at, out, block, directory = uuid.uuid4().hex, 0, None, [], []

        def flush() -> None:
            nonlocal at, out
            if block:
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
                data = zlib.compress("\n".join(json.dumps(x) for x in block).encode())
                out.write(data)
                directory.append((block[0][0], block[0][1], at, len(data)))
                at += len(data)
                block.clear()

        for batch in batches:
            for r in batch.to_pylist():
                block.append([r[c] for c in ("key", "page_id", "kind", "file", "at", "size")])
                if len(block) >= lines:
                    flush()
        flush()
        if directory:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], ["first", "page_id", "name"])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    shards = materialize(ordered.mapInArrow(write, "first string, page_id long, name string"), "shards")
    found = shards.collect()  # a row for each partition of the range
    return CaptureIndex(folder, sorted((_place(r["first"], r["page_id"]), r["name"]) for r in found))


class _Reader:
    """Binary search by (key, page_id) in the shards, directories and blocks; keeps the last directories and blocks."""

    def __init__(self, index: CaptureIndex):
        self.fs, self.root = pafs.FileSystem.from_uri(index.folder)
        self.index, self.firsts = index, [p for p, _ in index.shards]
        self.dirs: dict[int, tuple[list[Place], list]] = {}
        self.blocks: dict[tuple[int, int], tuple[list[Place], list]] = {}
        self.files: dict[int, pa.NativeFile] = {}

    def directory(self, s: int) -> tuple[list[Place], list]:
        if s not in self.dirs:
            if len(self.dirs) >= 4:
                self.dirs.clear()
            with self.fs.open_input_stream(f"{self.root}/{self.index.shards[s][1]}.dir", compression=None) as f:
                rows = json.loads(f.read())
            self.dirs[s] = ([_place(r[0], r[1]) for r in rows], rows)
        return self.dirs[s]

    def block(self, s: int, b: int) -> tuple[list[Place], list]:
        if (s, b) not in self.blocks:
            if len(self.blocks) >= 8:
                self.blocks.clear()
            if s not in self.files:
                for f in self.files.values():
                    f.close()
                self.files = {s: self.fs.open_input_file(f"{self.root}/{self.index.shards[s][1]}.cdx")}
            _, _, at, size = self.directory(s)[1][b]
            rows = [json.loads(x) for x in zlib.decompress(self.files[s].read_at(size, at)).decode().split("\n")]
            self.blocks[s, b] = ([_place(r[0], r[1]) for r in rows], rows)
        return self.blocks[s, b]

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """All captures of a key and page. Only captures equal in both can go on over blocks and shards, which are then
        read forward."""
        place = _place(key, page_id)
        s = max(0, bisect.bisect_left(self.firsts, place) - 1)
        while s < len(self.firsts) and self.firsts[s] <= place:
            firsts = self.directory(s)[0]
            b = max(0, bisect.bisect_left(firsts, place) - 1)
            while b < len(firsts) and firsts[b] <= place:
                places, rows = self.block(s, b)
                yield from rows[bisect.bisect_left(places, place) : bisect.bisect_right(places, place)]
                b += 1
            s += 1


def lookup(queries: DataFrame, index: CaptureIndex) -> DataFrame:
    """``queries``: key, page_id, both sorted within partitions for good use of what is read. Returns all captures of each.

    Queries that no capture answers give no row, one that comes twice gives its captures twice, a null page_id finds
    captures without page_id, and a null key nothing. Other columns are not read; an empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            rows = [r for k, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if k is not None for r in reader.find(k, p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "kind", "file", "at", "size"])

    return queries.select("key", F.col("page_id").cast("long")).mapInArrow(find, _CAPTURES)


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Range-read the records of captures, in file order: page_id, record_type, refers_to, payload_bytes, payload_digest
    (and with ``payload`` the payload, null for revisits).

    A capture that comes twice is read twice; a record that is not as it was written is an error. Other columns than file,
    at and size are not read; an empty table gives an empty result.
    """
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows, held = [], 0

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)  # noqa: B023
                rows.clear()  # noqa: B023
                return made

            for f, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{root}/{f}")
                r = parse_record(zlib.decompress(file.read_at(size, at), 31))
                rows.append((r.page_id, r.kind, r.refers_to, r.payload_bytes, r.digest, *([r.payload] if payload else [])))
                held += len(r.payload or b"") if payload else 0
                if held > BATCH_BYTES:
                    yield out()
                    held = 0
            if rows:
                yield out()
        if file is not None:
            file.close()

    return _dealt(captures.select("file", "at", "size"), "file", "at").select("file", "at", "size").mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, index them, look every page up and read its record back. An empty table gives an empty result."""
    folder = new_folder(spark, "warc")
    captures = materialize(write_archives(pages, folder, page_id, url, html), "captures")
    index = build_index(captures.select("key", "page_id", "kind", "file", "at", "size"), new_folder(spark, "cdx"))
    asked = pages.select(url_key(F.col(f"`{url}`")).alias("key"), F.col(f"`{page_id}`").cast("long").alias("page_id")).distinct()
    return read_records(lookup(_dealt(asked, "key", "page_id"), index), folder)
