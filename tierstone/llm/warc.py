"""WARC: write pages as records, and read archives in sequence.

Every record is a gzip member of its own. The reader takes a stream in pieces, inflates member by member, frames records by their
Content-Length and checks the payload digest; it never holds more than one record. Equal payloads of at least ``REVISIT_BYTES`` are stored
once: the record with the smallest page_id is the response, the others are revisits that name it.

Archives go to the shared folder through the file system of its URI. A task writes under names of its own, and only the archives that
the written list of a finished task names are read, so a task that ran twice or was lost does no harm.

Edge cases: null html is an empty payload; a null page_id is written as such, and comes after all others as a response to revisit; rows
that share the smallest page_id of a payload are all responses; a null url is an empty target; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fresh_path, slices, texts_of, written

REVISIT_BYTES, ARCHIVE_BYTES, READ_BYTES = 100, 64 << 20, 1 << 18
_URN = "urn:page:"
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is cut off, wrongly framed, or whose payload does not have its digest."""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A response or revisit as one gzip member. A revisit keeps the HTTP head, and with it the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    uri = "".join(c for c in url or "" if c >= " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{'null' if refers_to is None else refers_to}>"]
    raw = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member, inflated in pieces."""
    left = b""
    while True:
        left = left or stream.read(READ_BYTES)
        if not left:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left:
                raise WarcError("the archive ends within a record")
            parts.append(z.decompress(left))
            left = z.unused_data if z.eof else stream.read(READ_BYTES)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise WarcError("no record head")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers.get("content-length", -1))
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the block does not have its Content-Length")
    return headers, rest[:n]


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a response's digest is verified."""

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(_URN)
        return None if tail in ("", "null") else int(tail)

    for raw in members(stream):
        headers, block = parse(raw)
        head, mark, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        n = int(http.get("content-length", -1))
        algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
        kind = headers.get("warc-type", "")
        if not mark or n < 0 or algorithm != "sha256":
            raise WarcError("no payload length or digest")
        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise WarcError("the payload does not have its digest")
        yield number(headers.get("warc-record-id")), n, digest, kind, number(headers.get("warc-refers-to")) if kind == "revisit" else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; gives the list of archives: path, n_records."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    # written, so that AQE can split the join at a hot digest
    twice = written(rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min(place)["page_id"].alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("__digest"), "first", F.lit(True).alias("again")), "warc-twice")
    rows = rows.join(twice, F.col("digest") == F.col("__digest"), "left").select("page_id", "url", "html", "digest", "first", F.coalesce("again", F.lit(False)).alias("again"))

    def run(batches):
        made, out, path, n, size = [], None, "", 0, 0
        try:
            for part in slices(batches, "html"):
                for page, url, html, digest, first, again in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist()):
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        files, inner = _filesystem(path)
                        files.create_dir(inner.rpartition("/")[0], recursive=True)
                        out, n, size = files.open_output_stream(inner, compression=None), 0, 0
                    raw = record("revisit" if again and page != first else "response", page, url, html, digest, first)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= archive_bytes:
                        out.close()
                        made.append((path, n))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            made.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    return written(rows.mapInArrow(run, "path string, n_records long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the listed archives, one archive after the other in each task."""

    def run(batches):
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, inner = _filesystem(path)
                rows, seen = [], 0
                with files.open_input_stream(inner, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        seen += 1
                        if len(rows) == 1024:
                            yield batch(rows)
                            rows = []
                if seen != n:
                    raise WarcError(f"{path} has {seen} records, not {n}")
                yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # an archive is some megabytes of work in a row of some bytes, so the number of tasks is given and not left to sizes
    return archives.repartition(max(1, min(archives.count(), 100_000))).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
