"""WARC archives: writing with payload dedup, and a sequential reader.

*Writing.*  Each row becomes one record in a gzip member of its own.  Of the rows with
equal payloads (SHA-1) the one with the largest id is a ``response``; the others are
``revisit`` records, which name it and hold no payload.  Members are appended to archives of about
``ARCHIVE_BYTES``; archives are rows (archive, content) of a table, so a retried
or speculative task can't leave half an archive behind, and any store that Spark writes to will
do.  ``export`` writes them out as .warc.gz files, which ``read_files`` streams back.

*Reading.*  The archive is read member after member through an incremental
decompressor; the header block ends at the first empty line; Content-Length frames the
block; block and payload digests are verified.  A malformed archive raises ``WarcError``.
Revisits find their payload's length through the response that they refer to.

A null html is an empty payload; repeated rows of the largest id are responses all;
a null id comes before all others and refers like them; an empty table gives no archive and no record; a payload of any length is one record.
Equal payloads are counted by a partial aggregate of their hashes.  Where the repeated hashes are too many to be broadcast, the pages are shuffled once, payloads and all, to
meet them, in a join that AQE may split.  Archives are decompressed and verified once; the rest works on the records' slim columns.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm.runtime import core, written
from fenmark.sources.readers import opened

ARCHIVE_BYTES, READ_BYTES = 8 << 20, 64 << 10
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_ID = uuid.UUID("6f1c9a0e-51b1-5d5c-8a52-0f6a6c3ad001")
#: Records have a fixed date unless one is given: reruns write the same bytes.
DATE = datetime(2024, 1, 1, tzinfo=UTC)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    """An archive that can't be read as WARC."""


def sha1(data: bytes) -> str:
    """Base32, upper case, without a label."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id} {digest}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: datetime = DATE) -> bytes:
    """One record as a gzip member."""
    block = b"" if revisit else _HTTP % len(payload) + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    text = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(text.encode() + block + b"\r\n\r\n") + zip_.flush()


def members(archive: bytes | BinaryIO, step: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of an archive (its bytes, or a stream), read and decompressed a step at a time."""
    stream, held = io.BytesIO(archive) if isinstance(archive, bytes) else archive, b""
    while held or (held := stream.read(step)):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not held and not (held := stream.read(step)):
                raise WarcError("the archive ends within a member")
            try:
                parts.append(unzip.decompress(held))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            held = unzip.unused_data
        yield b"".join(parts)


def record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, framed by Content-Length."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header field: {line[:80]!r}")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    start, n = end + 4, int(head["content-length"])
    if data[start + n :] != b"\r\n\r\n":
        raise WarcError("the block's length isn't Content-Length")
    return head, data[start : start + n]


def payload_of(block: bytes) -> bytes:
    """An HTTP message's body."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no HTTP header")
    return block[end + 4 :]


def verified(head: dict[str, str], block: bytes) -> bytes | None:
    """The payload (None for a revisit), after a look at both digests."""
    if head.get("warc-block-digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
        raise WarcError("the block's digest differs")
    if head.get("warc-type") == "revisit":
        return None
    payload = payload_of(block)
    if head.get("warc-payload-digest", f"sha1:{sha1(payload)}") != f"sha1:{sha1(payload)}":
        raise WarcError("the payload's digest differs")
    return payload


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (page_id, url, payload, sha, refers_to, revisit): archives of about ARCHIVE_BYTES."""
    parts, size = [], 0

    def packed() -> pa.RecordBatch:
        content = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:32]]), pa.array([len(parts)], pa.int64()), pa.array([content], pa.binary())], ["archive", "records", "content"])

    for batch in batches:
        columns = (batch.column(c) for c in ("page_id", "url", "payload", "sha", "refers_to", "revisit"))
        for page_id, url, payload, sha, refers_to, revisit in zip(*columns, strict=True):
            one = member(page_id.as_py(), url.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(sha.as_py())).decode(), refers_to.as_py(), revisit.as_py())
            if parts and size + len(one) > ARCHIVE_BYTES:
                yield packed()
                parts, size = [], 0
            parts.append(one)
            size += len(one)
    if parts:
        yield packed()


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(archive, records, content): the rows of pages as WARC archives."""
    rows = core(pages, key, payload, url=url).select(F.col("doc_id").alias("page_id"), "url", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    last = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("_sha"), "last")
    # Written first, so that the join deals both sides anew and AQE may split a payload that very many rows share.
    last = written(last, "payloads")
    revisit = F.col("_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    told = rows.join(last, rows.sha == last["_sha"], "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("last")))
    # A revisit needs no payload: it is dropped before the rows go to Python.
    slim = told.select("page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "sha", "refers_to", "revisit")
    return slim.mapInArrow(_archives, "archive string, records long, content binary")


_RECORDS = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64())])


def _record_batches(archive: bytes | BinaryIO) -> Iterator[pa.RecordBatch]:
    """The verified records of an archive, about ARCHIVE_BYTES of them at a time."""
    out, size = [], 0
    for data in members(archive):
        head, block = record(data)
        body = verified(head, block)
        number = lambda name, h=head: int(h[name]) if h.get(name) else None
        out.append({"record_type": head.get("warc-type"), "page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or sha1(body or b""), "refers_to": number("x-refers-to-page"), "payload": body, "payload_bytes": None if body is None else len(body)})
        size += len(data)
        if size > ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pylist(out, _RECORDS)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _RECORDS)


_READ = "record_type string, page_id long, url string, payload_digest string, refers_to long, payload binary, payload_bytes long"


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (content): record_type, page_id, url, payload_digest, refers_to, payload, payload_bytes (both null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _record_batches(content.as_buffer().to_pybytes() if content.is_valid else b"")

    return archives.select("content").mapInArrow(run, _READ)


def read_files(spark: SparkSession, path: str, pattern: str = "*.warc.gz") -> DataFrame:
    """read() of archive files of any size under a path, with a column ``file``.

    A gzip stream can't be entered in its middle, so a file is one task's work; it is read READ_BYTES at a time, and no more than a batch of its
    records is in memory.  Spark lists the files and deals them to tasks by their sizes; an empty file has no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as stream:
                    for found in _record_batches(stream):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * found.num_rows), *found.columns], ["file", *found.schema.names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")  # the content isn't read here
    return files.mapInArrow(run, f"file string, {_READ}")


def resolved(records: DataFrame) -> DataFrame:
    """records (a table of their slim columns, as it is read more than once), revisits with the payload_bytes of their response."""
    slim = records.drop("payload", "url")
    known = slim.where("record_type <> 'revisit'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("known")).withColumnRenamed("payload_digest", "_digest")
    revisits = slim.where("record_type = 'revisit'").join(known, F.col("payload_digest") == F.col("_digest"), "left").withColumn("payload_bytes", F.col("known")).select(*slim.columns)
    return slim.where("record_type <> 'revisit'").unionByName(revisits)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes pages as archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = written(read(written(archives(pages, key, url, payload), "warc")).drop("payload"), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive to folder, a path that executors share (any pyarrow file system URI); returns (archive, file).

    A file is written under another name and moved to its own, which is made of its content's hash: retries change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            files = []
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                part, file = (f"{root}/{x}" for x in (f".{name}.{os.getpid()}.{uuid.uuid4().hex}", f"{name}.warc.gz"))
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, file)
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(files, pa.string())], ["archive", "file"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, file string")
