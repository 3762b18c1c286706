"""WARC archives with a two-level capture index.

Writing: each task writes its rows as records, a gzip member each, into files of its own below the
shared folder, and returns where each record lies. Of records with equal payloads (by SHA-256)
the one with the least page id carries the payload; the others are revisits of it.

Index: captures are sorted by their key, the URL with its host reversed and the page id, over
range partitions. A partition is one index file: compressed blocks of ``BLOCK`` captures, then
the sparse directory of the blocks' first keys, then its length. A table with one row per index
file has the first key of each.

Look-up: each different key is sent to the index files that may hold it (binary search over the
files' first keys), there to the blocks that may (binary search over the directory, read by
range), there to its captures (binary search); all captures of a key are found, however many there
are. They are grouped by archive file and records are read by range.

The broadcast list has a row per index file, that is per shuffle partition. A failed attempt's
files are left unreferenced. Files are reached through pyarrow's file systems, by the shared
folder's full path as Spark has it; a scheme that pyarrow can't open raises an error.

Defined results: page ids are whole numbers. Null html is an empty payload, a null url has the key
``-``, a null page id sorts as -1. Rows that share page id and url have one key: each of them is a
record, and a look-up of the key returns all of them. Rows that repeat the least page id of a
payload are each responses. An empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrows import mapped
from .staging import Staging

BLOCK = 512
#: A new archive file is begun beyond so many bytes.
FILE_BYTES = 256 << 20
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20
CAPTURE = "key string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def surt(url: str | None) -> str:
    """The URL with its host reversed, without scheme, port and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {(-1 if page_id is None else page_id) + (1 << 62):020d}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload if is_first else http
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_first else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {json.dumps(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if not is_first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields of one record, its payload checked against its digest and length."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda s: None if s == "<urn:page:none>" else int(s[len("<urn:page:") : -1])
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": json.loads(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"]}
    size, sha = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or digest(payload) != sha:
            raise ValueError(f"record of page {out['page_id']} is damaged")
        return out | {"payload": payload, "payload_bytes": size, "payload_digest": sha, "refers_to": None}
    return out | {"payload": None, "payload_bytes": size, "payload_digest": sha, "refers_to": number(fields["WARC-Refers-To"])}


def _open(base: str) -> tuple[fs.FileSystem, str]:
    """The file system of a full path, and the path in it."""
    scheme, _, rest = base.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else base)


@dataclass(frozen=True)
class Archive:
    """Where the files are, and the table of index files (file, first_key, at, length)."""

    base: str
    files: DataFrame


def write_archive(pages: DataFrame) -> Archive:
    """Writes a record for each row of ``pages`` (page_id, url, html), and the index."""
    stage = Staging(pages.sparkSession, "warc")
    base = stage.path("archive")
    _open(base)  # raises here for a scheme that the executors could not open
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    firsts = rows.groupBy("sha").agg(F.min(F.struct("page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", F.lit(True).alias("shared"), "first")
    firsts = stage.put(firsts, "firsts")
    told = rows.join(firsts, "sha", "left").select(
        "page_id", "url", "html", F.col("first.page_id").alias("first"), (F.col("shared").isNull() | F.col("first.page_id").eqNullSafe(F.col("page_id"))).alias("is_first")
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(base)
        system.create_dir(root, recursive=True)
        sink = name = None
        at = 0
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "is_first")), strict=True):
                if sink is None or at > FILE_BYTES:
                    if sink:
                        sink.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(row[0], row[1], row[2].encode(), row[3], row[4])
                sink.write(member)
                found.append((capture_key(row[1], row[0]), name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["key", "file", "offset", "length"])
        if sink:
            sink.close()

    captures = stage.put(mapped(told, written, CAPTURE), "captures")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(base)
        sink, name, at = None, f"{uuid.uuid4().hex}.cdx", 0
        directory: list[tuple[str, int, int]] = []
        held: list[list] = []

        def flush(rows_: list[list]) -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(r) for r in rows_).encode(), 6)
            sink.write(block)
            directory.append((rows_[0][0], at, len(block)))
            at += len(block)

        for batch in batches:
            held += [list(r) for r in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True)]
            if held and sink is None:
                sink = system.open_output_stream(f"{root}/{name}", compression=None)
            while len(held) >= BLOCK:
                flush(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            flush(held)
        if sink:
            packed = zlib.compress(json.dumps(directory).encode())
            sink.write(packed)
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], at, len(packed))], ["file", "first_key", "at", "length"])

    ranged = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    files = stage.put(mapped(ranged, indexed, "file string, first_key string, at long, length long"), "files")
    stage.drop("captures", "firsts")
    return Archive(base, files)


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, size, records) of reads that cover ordered (offset, length) records."""
    group: list[tuple[int, int]] = []
    for row in rows:
        if group and row[0] + row[1] - group[0][0] > RANGE_BYTES:
            yield group[0][0], group[-1][0] + group[-1][1] - group[0][0], group
            group = []
        group.append(row)
    if group:
        yield group[0][0], group[-1][0] + group[-1][1] - group[0][0], group


def look_up(archive: Archive, wanted: DataFrame) -> DataFrame:
    """All captures (key, file, offset, length) of the different keys of ``wanted`` (page_id, url)."""
    base = archive.base
    top = sorted((r["first_key"], r["file"], r["at"], r["length"]) for r in archive.files.collect())  # a row per index partition
    firsts = [t[0] for t in top]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                key = capture_key(url, page)
                held = range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))  # equal keys may be in several files
                parts += held
                keys += [key] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(base)
        opened = at_block = last = None
        directory: list = []
        block: list = []
        keys_: list[str] = []
        for batch in batches:
            found = []
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if (part, key) == last:  # ordered, so different urls with one key are neighbours
                    continue
                last = part, key
                _, file, at, length = top[part]
                if opened != part:
                    source = system.open_input_file(f"{root}/{file}")
                    directory = json.loads(zlib.decompress(source.read_at(length, at)))
                    begin, opened, at_block = [d[0] for d in directory], part, None
                for k in range(max(bisect_left(begin, key) - 1, 0), bisect_right(begin, key)):
                    if at_block != k:
                        block = [json.loads(x) for x in zlib.decompress(source.read_at(directory[k][2], directory[k][1])).decode().split("\n")]
                        keys_, at_block = [x[0] for x in block], k
                    found += block[bisect_left(keys_, key) : bisect_right(keys_, key)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["key", "file", "offset", "length"])

    different = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).distinct()
    return mapped(mapped(different, sent, "part int, key string").repartition("part").sortWithinPartitions("part", "key"), searched, CAPTURE)


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of the captures, read by range and checked."""
    base = archive.base

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(base)
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        opened, source = None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            rows = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a]:
                    b += 1
                if opened != files[a]:
                    opened, source = files[a], system.open_input_file(f"{root}/{files[a]}")
                for start, size, group in _ranges(rows[a:b]):
                    data = source.read_at(size, start)
                    found = [parse_record(data[o - start : o - start + n]) for o, n in group]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in zip(names, types, strict=True)], names)
                a = b

    stretch = F.expr("offset div 8388608")
    return mapped(captures.repartition("file", stretch).sortWithinPartitions("file", "offset"), read, RECORD)
