"""WARC archives of web pages with a two-level capture index.

Each task writes the records of its rows to an archive of its own, one gzip member for each record. The capture index
sorts reversed-host URL keys by range into parts of at most INDEX_PARTS; a part is a file of compressed blocks of BLOCK_LINES
captures and a sparse directory with the first key, offset and length of each block. A lookup finds the part by binary
search in the list of parts, the block by binary search in the part's directory, and then reads two byte ranges: the
block, and the record. Reading back looks up every distinct key in the same way: keys are dealt to the parts that may hold
them, a part's task goes through its directory and blocks in the order of keys, and records are read in archive order. A key
with many captures spans many parts, so it is not read by one task.

Payloads of at least MIN_REVISIT bytes that occur again are stored once: the record with the largest page id is the
response, the others are revisits that refer to it. Largest ids are pre-aggregated by digest; pages of a payload that many
share get theirs from a bounded broadcast list.

Archive names hold the task attempt, and the list of parts is read only from committed tables, so a task that runs again
cannot mix its files with those of an earlier attempt.

Defined results: null html is an empty payload. A null url has the empty key. Ids of any type are kept as text in the records
and cast back. Null ids come back as null, and null counts as less than every id. Rows that share the largest id of a payload
are all responses. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import Stored, attach, configure, delete_at_exit, fresh_path

MIN_REVISIT, BLOCK_LINES, INDEX_PARTS = 1000, 1000, 4096
#: Bytes an archive may reach before the task starts another.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: com,example,www)/path?query. What cannot be parsed is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return quote(url, safe=_SAFE)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe=_SAFE)


_SAFE = "!#$%&'()*+,/:;=?@[]~"


_NO_PAGE = "<urn:no-page>"


def _record_id(page_id: str | None) -> str:
    return _NO_PAGE if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _page_id(record_id: str) -> str | None:
    return None if record_id == _NO_PAGE else unquote(record_id.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record, not compressed; a revisit keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{sha1}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Capture:
    """What one record holds; ids as text."""

    page_id: str | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: str | None
    payload: bytes | None


def parse(raw: bytes) -> Capture:
    """The capture in one record; a payload that doesn't have the digest it is said to have is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return Capture(_page_id(fields["WARC-Record-ID"]), fields["WARC-Type"], size, digest, _page_id(fields["WARC-Refers-To"]) if revisit else None, None if revisit else body)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Appender:
    """A file of gzip members; add() tells where a member stands."""

    def __init__(self, uri: str) -> None:
        store, path = _store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.at, self.out = 0, store.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        start, self.at = self.at, self.at + len(member)
        return start, len(member)

    def close(self) -> None:
        self.out.close()


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():05d}-{context.taskAttemptId()}"


@dataclass(frozen=True)
class Archive:
    """Where the files are, the committed list of index parts (file, first_key), the keys there are, and the type of the ids."""

    path: str
    parts: DataFrame
    keys: DataFrame
    id_type: str


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    spark = pages.sparkSession
    configure(spark)
    path = fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.coalesce(html_col, F.lit("")).alias("h"))
    rows = rows.withColumn("d", F.sha1("h")).withColumn("spread", F.xxhash64("i", "u"))
    long_ones = rows.select("d", "i", F.octet_length("h").alias("n")).where(F.col("n") >= MIN_REVISIT)
    again = Stored(long_ones.groupBy("d").agg(F.max("i").alias("m"), F.count("*").alias("c")).where("c > 1"), "payloads")
    rows = attach(rows, again.rows, "d", "c", "spread", keep=True)
    as_text = [F.col(c).cast("string").alias(c) for c in ("i", "m")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number, out = _attempt(), 0, None
        for batch in batches:
            index = []
            for i, url, html, digest, last in zip(*(tx.column(batch, c).to_pylist() for c in ("i", "u", "h", "d", "m")), strict=True):
                if out is None or out.at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    file = f"archives/{name}-{number:04d}.warc.gz"
                    number, out = number + 1, _Appender(f"{path}/{file}")
                revisit = last is not None and i != last
                start, size = out.add(record(i, url, html.encode(), digest, last if revisit else None, revisit))
                index.append((url_key(url), i, file, start, size))
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "i", "file", "start", "size"])
        if out is not None:
            out.close()

    captures = Stored(rows.select("u", "h", "d", *as_text).mapInArrow(write, "key string, i string, file string, start long, size long"), "captures")
    again.discard()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, lines, made = _attempt(), None, [], []

        def flush() -> None:
            nonlocal out
            out = out or _Appender(f"{path}/index/{name}.blocks")
            start, size = out.add("\n".join(lines).encode())
            made.append((lines[0].partition(" ")[0], start, size))
            lines.clear()

        for batch in batches:
            for key, i, file, start, size in zip(*(tx.column(batch, c).to_pylist() for c in ("key", "i", "file", "start", "size")), strict=True):
                lines.append(f"{key} {json.dumps([i, file, start, size])}")
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            directory = _Appender(f"{path}/index/{name}.directory")
            directory.add("\n".join(json.dumps(m) for m in made).encode())
            directory.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"index/{name}"]), pa.array([made[0][0]])], ["file", "first_key"])

    count = min(INDEX_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.rows.repartitionByRange(count, "key", "i", "file", "start").sortWithinPartitions("key", "i", "file", "start")
    parts = Stored(ordered.mapInArrow(build, "file string, first_key string"), "parts")
    delete_at_exit(spark, path)
    return Archive(path, parts.rows, captures.rows.select("key").distinct(), pages.schema[id_col].dataType.simpleString())


def _block_lines(path: str, file: str, start: int, size: int, opened: dict) -> list[str]:
    return gzip.decompress(_range(f"{path}/{file}", start, size, opened)).decode().split("\n")


def _range(uri: str, start: int, size: int, opened: dict) -> bytes:
    if uri not in opened:
        while len(opened) >= 4:
            opened.pop(next(iter(opened))).close()
        store, path = _store(uri)
        opened[uri] = store.open_input_file(path)
    return opened[uri].read_at(size, start)


def _directory(path: str, file: str) -> list[tuple[bytes, int, int]]:
    """(first key, offset, length) of each block of a part."""
    store, where = _store(f"{path}/{file}.directory")
    with store.open_input_file(where) as f:
        return [(k.encode(), start, size) for k, start, size in map(json.loads, gzip.decompress(f.read()).decode().split("\n"))]


def _may_hold(firsts: list[bytes], want: bytes) -> range:
    """Places in a sorted list of first keys whose part or block may hold the key: the one before the first as large, and all equal ones."""
    return range(max(0, bisect_left(firsts, want) - 1), bisect_right(firsts, want))


class _Part:
    """One part of the index; the block that was read last is kept, so keys in order read each block once."""

    def __init__(self, path: str, file: str, opened: dict) -> None:
        self.path, self.file, self.opened = path, file, opened
        self.blocks = _directory(path, file)
        self.firsts = [b[0] for b in self.blocks]
        self.at, self.keys, self.lines = -1, [], []

    def lookup(self, want: bytes) -> Iterator[tuple[str, int, int]]:
        """Archive file, offset and length of the key's captures in this part, in order."""
        for k in _may_hold(self.firsts, want):
            if k != self.at:
                _, start, size = self.blocks[k]
                split = [line.partition(" ") for line in _block_lines(self.path, f"{self.file}.blocks", start, size, self.opened)]
                self.at, self.keys, self.lines = k, [line[0].encode() for line in split], [line[2] for line in split]
            for line in self.lines[bisect_left(self.keys, want) : bisect_right(self.keys, want)]:
                yield tuple(json.loads(line)[1:])


def _listed_parts(archive: Archive) -> tuple[list[bytes], list[str]]:
    """First keys and files of the parts, in order: INDEX_PARTS at most."""
    listed = sorted((r.first_key.encode(), r.file) for r in archive.parts.collect())
    return [k for k, _ in listed], [f for _, f in listed]


def read_archive(archive: Archive, keys: DataFrame | None = None) -> DataFrame:
    """The captures of the distinct keys (all there are, unless `keys` has a column key with others), by way of the index."""
    path, spark = archive.path, archive.parts.sparkSession
    firsts, files = _listed_parts(archive)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(files[k], key) for key in tx.column(batch, "key").to_pylist() for k in _may_hold(firsts, key.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["part", "key"])

    dealt = (archive.keys if keys is None else keys.select("key").distinct()).mapInArrow(deal, "part string, key string")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        part = None
        for batch in batches:
            for file, key in zip(tx.column(batch, "part").to_pylist(), tx.column(batch, "key").to_pylist(), strict=True):
                if part is None or part.file != file:
                    part = _Part(path, file, opened)
                found = part.lookup(key.encode())
                while some := list(islice(found, BLOCK_LINES)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "size"])

    # Keys sort by their UTF-8 bytes here and in the index alike.
    listed = dealt.repartition(count, "part").sortWithinPartitions("part", "key").mapInArrow(look_up, "file string, start long, size long")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            out = []
            for file, start, size in zip(*(tx.column(batch, c).to_pylist() for c in ("file", "start", "size")), strict=True):
                c = parse(zlib.decompress(_range(f"{path}/{file}", start, size, opened), 31))
                out.append((c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to, file, start))
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive_file", "archive_offset"])

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive_file string, archive_offset long"
    found = listed.repartition("file").sortWithinPartitions("file", "start").mapInArrow(records, schema)
    return found.withColumns({c: F.col(c).cast(archive.id_type) for c in ("page_id", "refers_to")})


class CaptureIndex:
    """Lookups of single URLs. Only the list of parts is held in memory."""

    def __init__(self, archive: Archive) -> None:
        self.path = archive.path
        self.firsts, self.files = _listed_parts(archive)
        self.opened: dict = {}

    def lookup(self, url: str | None) -> list[Capture]:
        """All captures of a URL, revisits included, in index order."""
        want, out = url_key(url).encode(), []
        for k in _may_hold(self.firsts, want):
            for file, start, size in _Part(self.path, self.files[k], self.opened).lookup(want):
                out.append(parse(zlib.decompress(_range(f"{self.path}/{file}", start, size, self.opened), 31)))
        return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(archive).drop("archive_file", "archive_offset")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM d
"""
