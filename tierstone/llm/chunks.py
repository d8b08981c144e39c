"""Texts in written chunks, and counts of keys over all chunks that come back to each chunk.

A chunk is a row with some megabytes of whole texts, compressed. Python makes a chunk's keys (64-bit, distinct within the
chunk), ``entries`` deals them by their leading bits into buckets, ``totals`` sorts one bucket at a time and adds up, and
``returned`` brings the totals back beside the chunk. A key that a third of all documents hold is one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from .util import slices, texts_of, written

CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Texts of a chunk at most, so that null and empty ones, which take no bytes, do not gather in one.
CHUNK_ROWS = 1 << 16
CHUNK = "chunk_id long, n_bytes long, ids binary, lengths binary, blob binary"
ENTRY = "bucket int, chunk_id long, keys binary, counts binary"


def squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def loosen(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def write_chunks(rows: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``rows`` has a non-null long and a text. A longer text than ``size`` has a chunk of its own; nulls count as empty."""

    def run(batches):
        task, made, held, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def chunk() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            cols = [[task << 32 | made], [held], [np.array(ids, "<i8").tobytes()], [np.array([len(t) for t in texts], "<i8").tobytes()], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["chunk_id", "n_bytes", "ids", "lengths", "blob"])

        for part in slices(batches, part_text):
            for i, t in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                t = t or b""
                if texts and (held + len(t) > size or len(texts) == CHUNK_ROWS):
                    yield chunk()
                    made, held, ids, texts = made + 1, 0, [], []
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield chunk()

    part_text = rows.columns[1]
    return written(rows.mapInArrow(run, CHUNK), "chunks")


def opened(row: dict) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a chunk."""
    lengths = np.frombuffer(row["lengths"], "<i8").tolist()
    raw = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["n_bytes"]))
    texts, at = [], 0
    for n in lengths:
        texts.append(raw[at : at + n])
        at += n
    return np.frombuffer(row["ids"], "<i8").tolist(), texts


def bucket_bits(chunks: DataFrame) -> int:
    """Bits of a key that name its bucket, so that a bucket holds the keys of about BUCKET_BYTES of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, (total // BUCKET_BYTES).bit_length())


def dealt(keys: np.ndarray, counts: np.ndarray, bits: int, kind: str, chunk_id: int, buckets: np.ndarray | None = None) -> Iterator[tuple]:
    """Entry rows of a chunk's keys, sorted by bucket and key; without ``buckets`` these are the bits above the low 32 of a key."""
    at = np.searchsorted(keys >> np.uint64(32) if buckets is None else buckets, np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        n = counts[part]
        yield b, chunk_id, keys[part].astype(kind).tobytes(), b"" if (n == 1).all() else squeeze(n.astype("<u4"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that one row's payload is copied at once."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["bucket", "chunk_id", "keys", "counts"])


def totals(entries: DataFrame, kind: str) -> DataFrame:
    """For each entry row the totals of its keys over all chunks: chunk_id, bucket, totals."""

    def run(batches):
        rows, bucket = [], None
        for r in rows_of(batches):
            if rows and r["bucket"] != bucket:
                yield add(rows)
                rows = []
            bucket = r["bucket"]
            rows.append(r)
        if rows:
            yield add(rows)

    def add(rows: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], kind) for r in rows]
        counts = np.concatenate([loosen(r["counts"], "<u4") if r["counts"] else np.ones(len(k), "<u4") for r, k in zip(rows, keys)]).astype(np.int64)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])
        group = np.cumsum(first) - 1
        total = np.add.reduceat(counts[order], np.flatnonzero(first))[group]
        back = np.empty(len(flat), "<u4")
        back[order] = np.minimum(total, 2**32 - 1)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        cols = [[r["chunk_id"] for r in rows], [r["bucket"] for r in rows], [squeeze(x) for x in np.split(back, cuts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.binary()])], names=["chunk_id", "bucket", "totals"])

    ready = entries.repartition("bucket").sortWithinPartitions("bucket")
    return ready.mapInArrow(run, "chunk_id long, bucket int, totals binary")


def returned(chunks: DataFrame, backs: list[DataFrame], use: Callable[..., Iterator[pa.RecordBatch]], schema: str, *types) -> DataFrame:
    """Call ``use(chunk row, totals in key order, ...)`` for each chunk, with one array of totals for each of ``backs``, of 32-bit counts or of ``types``."""
    own = [f for f in chunks.schema.fields if f.name != "chunk_id"]
    both = chunks.select("chunk_id", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), *(f.name for f in own), F.lit(None).cast("binary").alias("payload"))
    for i, back in enumerate(backs, 1):
        nulls = (F.lit(None).cast(f.dataType).alias(f.name) for f in own)
        both = both.unionByName(back.select("chunk_id", F.lit(i).alias("kind"), "bucket", *nulls, F.col("totals").alias("payload")))
    types = types or ("<u4",) * len(backs)

    def run(batches):
        held, parts = None, []
        for r in rows_of(batches):
            if r["kind"] == 0:
                if held:
                    yield from use(held, *map(np.concatenate, parts))
                held, parts = r, [[np.zeros(0, t)] for t in types]
            else:
                parts[r["kind"] - 1].append(loosen(r["payload"], types[r["kind"] - 1]))
        if held:
            yield from use(held, *map(np.concatenate, parts))

    return both.repartition("chunk_id").sortWithinPartitions("chunk_id", "kind", "bucket").mapInArrow(run, schema)
