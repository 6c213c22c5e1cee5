"""Operator 6: WARC archives written, normalised from monolithic gzip to a member a record, and read back by index.

write_archives() lays the pages out as WARC/1.1 records, a whole archive in one gzip stream, as careless writers do.
normalise() inflates such a stream once, in blocks, rewrites each record as a gzip member of its own and notes each
member's offset and length: the sidecar index, stored as a line of JSON a record beside the archive. read_archives()
seeks to each offset of the index and parses only that member.

Payloads that several pages share are stored once: the smallest page_id's record is a response, the others revisit it.

Archives go to the shared folder (spark.checkpoint.dir, any file system that pyarrow opens by URI). Each task attempt
writes files of its own name, and a table written by Spark's commit lists those of the attempts that counted, so lost
executors and repeated attempts leave at most unused files.

Defined results: null html is an empty payload, and all empty payloads are equal; pages that repeat page_id and payload
are all responses if theirs is the smallest id; null page ids sort last, hence revisit if anyone else has the payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, map_batches, read, scratch_path, table

#: An archive takes records until it holds so many bytes of payload; the normaliser inflates by so many bytes at a time; tasks that read archives at most.
ARCHIVE_BYTES, BLOCK, READ_TASKS = 64 << 20, 1 << 18, 20_000
#: Records have a date fixed by a parameter, so that reruns write the same bytes.
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A WARC record; a revisit carries no payload, but its length and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that data begins with, and the bytes it takes; ValueError if it isn't whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    lines = data[:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or len(data) < end + 4 + size + 4:
        raise ValueError("not a whole record")
    return headers, data[end + 4 : end + 4 + size], end + 4 + size + 4


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    """The inflated bytes of one or more gzip streams, once, a block at a time."""
    z, begun = zlib.decompressobj(31), False
    while chunk := source.read(BLOCK):
        while chunk:
            begun = True
            yield z.decompress(chunk, BLOCK)
            while not z.eof and z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, BLOCK)
            while not z.eof and (more := z.decompress(b"", BLOCK)):
                yield more
            chunk = z.unused_data
            if z.eof and chunk:
                z = zlib.decompressobj(31)
    if begun and not z.eof:
        raise ValueError("the stream ends before its gzip trailer")


def records_of(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream; holds one record at most."""
    have, need = bytearray(), 0
    for block in blocks:
        have += block
        while True:
            if not need:
                if (end := have.find(b"\r\n\r\n")) < 0:
                    break
                sizes = [int(x[15:]) for x in bytes(have[:end]).split(b"\r\n") if x.startswith(b"Content-Length:")]
                need = end + 4 + sizes[0] + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = 0
    if have:
        raise ValueError("the stream ends inside a record")


def normalise(source: BinaryIO, target: BinaryIO, level: int = 6) -> list[dict]:
    """Rewrites a gzip stream of records with a member a record; the index: offset, length, id, type and URI of each."""
    index, at = [], 0
    for raw in records_of(_inflated(source)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        target.write(member)
        headers = parse(raw)[0]
        index.append({"offset": at, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "uri": headers["WARC-Target-URI"]})
        at += len(member)
    return index


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


class _Archive:
    """A monolithic archive in the making."""

    def __init__(self, folder: str) -> None:
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{root}/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.name}.raw.gz", compression=None)
        self.z, self.payload = zlib.compressobj(1, zlib.DEFLATED, 31), 0

    def add(self, raw: bytes) -> None:
        self.out.write(self.z.compress(raw))
        self.payload += len(raw)

    def close(self) -> tuple[str, str, int]:
        """Ends the stream, normalises it and drops it; path and index path of the normalised archive, and its records."""
        self.out.write(self.z.flush())
        self.out.close()
        with self.fs.open_input_stream(f"{self.name}.raw.gz", compression=None) as a, self.fs.open_output_stream(f"{self.name}.warc.gz", compression=None) as b:
            index = normalise(a, b)
        with self.fs.open_output_stream(f"{self.name}.cdxj", compression=None) as f:
            f.write("".join(json.dumps(x) + "\n" for x in index).encode())
        self.fs.delete_file(f"{self.name}.raw.gz")
        return f"{self.name}.warc.gz", f"{self.name}.cdxj", len(index)


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to (null: a response). The pages are shuffled once, by the payload's digest; payloads that very many pages share are not."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    thin = rows.select("page_id", "_digest")
    shared = thin.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    shared = table(pages.sparkSession, shared, "payloads")
    met = attach(rows, shared, "_digest", pages.count(), "_n", F.xxhash64("page_id", "url"))
    first = F.when(F.col("page_id").eqNullSafe(F.col("_first")), F.lit(None)).otherwise(F.col("_first"))
    return met.select("page_id", "url", "html", first.cast("long").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages with refers_to -> a row for each archive written: path, index, records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Archive | None = None
        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"].astype(object), b["url"], b["html"], b["refers_to"].astype(object), strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                now = now or _Archive(folder)
                now.add(record(page, url, html.encode("utf-8", "surrogatepass"), refers, refers is not None))
                if now.payload >= archive_bytes:
                    yield pd.DataFrame([now.close()], columns=["path", "index", "records"])
                    now = None
        if now:
            yield pd.DataFrame([now.close()], columns=["path", "index", "records"])

    return map_batches(pages, run, "path string, index string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record, read by the sidecar index; digests and lengths of responses are those of the payload read."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None) -> int | None:
        return int(x) if urn and (x := urn[len("<urn:page:") : -1]) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _fs(folder)
        for b in batches:
            for path, index in zip(b["path"], b["index"], strict=True):
                out = []
                with fs.open_input_stream(index, compression=None) as lines, fs.open_input_file(path) as archive:
                    for line in lines.read().decode().splitlines():
                        x = json.loads(line)
                        archive.seek(x["offset"])
                        headers, payload, _ = parse(zlib.decompress(archive.read(x["length"]), 31))
                        said, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        kind = headers["WARC-Type"]
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"{path}: the record at {x['offset']} is damaged")
                        out.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, said, kind, number(headers.get("WARC-Refers-To"))))
                f = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield f.astype({"page_id": "Int64", "refers_to": "Int64"})

    return map_batches(archives, run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    archives = table(spark, write_archives(with_roles(read(spark, sf_dir, "pages")), folder), "archives")
    # The rows that name archives are few and small, so they are dealt out: an archive a task, several if there are many.
    return read_archives(archives.repartition(min(max(1, archives.count()), READ_TASKS)), folder).drop("url")
