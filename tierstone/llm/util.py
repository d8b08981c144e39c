"""Shared helpers: the shared folder, written tables, bounded Arrow slices, hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, shared_dir

#: Rows handed to a Python loop at once, and the bytes of text in them (one longer text comes alone).
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20

_written: list[tuple[SparkSession, str]] = []
_here = threading.local()


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tierstone/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    for mine in getattr(_here, "owners", []):
        mine.append((spark, path))
    return path


@contextlib.contextmanager
def owned() -> Iterator[list[tuple[SparkSession, str]]]:
    """The folders that the block asks for in this thread, so that its caller can delete these and no others."""
    mine: list[tuple[SparkSession, str]] = []
    before = getattr(_here, "owners", [])
    _here.owners = [*before, mine]
    try:
        yield mine
    finally:
        _here.owners = before


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone when Python ends
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from written() that no pending plan reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds a bounded number of rows and bytes of ``text``."""
    for batch in batches:
        sizes = np.asarray(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pandas().map(lambda b: 0 if b is None else len(b)), dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start : start + SLICE_ROWS])
            n = max(1, int(np.searchsorted(total, SLICE_BYTES, side="right")))
            yield batch.slice(start, min(n, SLICE_ROWS))
            start += min(n, SLICE_ROWS)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A Python worker's cache for one kind of work; what other kinds left in the same worker goes."""
    for other in [n for n in _caches if n != name]:
        del _caches[other]
    return _caches.setdefault(name, {})


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, n of them at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
    return _powers[base]


def with_row_id(docs: DataFrame, tag: str, name: str = "__rid") -> DataFrame:
    """``docs`` written once with a stable row identity, which doc_id need not be (nulls, repeated rows)."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), tag)


def checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint only where its counted rows are within ``most``."""
    return F.broadcast(df) if rows <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
