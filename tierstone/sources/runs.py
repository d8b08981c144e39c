"""Writing and reading immutable runs: Parquet, sorted by key, with disjoint key ranges per file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RUN
from .manifest import Config, Files, Run

ENTRIES_PER_FILE = 8_000_000


def write(files: Files, rows: DataFrame, config: Config, n: int, stats: tuple | None = None) -> Run | None:
    """Write a run of unique keys; None if there is nothing. ``n`` (an upper bound of their number) sizes files and Bloom filters; ``stats`` (entries, smallest
    and largest key, highest seq) are taken from what was written, where they are not known."""
    name = f"run-{uuid.uuid4().hex}"
    parts = max(1, -(-n // ENTRIES_PER_FILE))
    # small runs come in one file, sorted in one task whose size is bounded; what makes the rows keeps its own tasks
    rows = rows.repartitionByRange(parts, "key") if parts > 1 else rows.repartition(1)
    out = rows.select("key", "value", "seq", "is_delete").sortWithinPartitions("key").write
    if config.enable_bloom_filter:
        # Parquet takes the number of values and a false positive rate in place of bits per entry
        k = config.bloom_filter_bits_per_entry
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, min(n, ENTRIES_PER_FILE)))).option("parquet.bloom.filter.fpp#key", f"{max(1e-6, 0.6185**k):.6f}").option("parquet.enable.dictionary#key", "false")
    if config.sst_implementation == "btree":
        out = out.option("parquet.page.row.count.limit", "4096")  # finer page index
    out.parquet(f"{files.root}/{name}")
    s = stats or tuple(read(files, Run(name, 0, 0, 0, 0)).agg(*stats_of()).first())
    if not s[0]:
        files.delete(name)
        return None
    return Run(name, *s, bloom=config.enable_bloom_filter, layout=config.sst_implementation)


def stats_of() -> list:
    return [F.count("*"), F.min("key"), F.max("key"), F.max("seq")]


def spool(files: Files, rows: DataFrame) -> tuple[str, DataFrame, tuple]:
    """``rows`` as they came out of one evaluation: folder, table and stats."""
    name = f".spool-{uuid.uuid4().hex}"
    rows.select("key", "value", "seq", "is_delete").write.parquet(f"{files.root}/{name}")
    held = files.spark.read.schema(RUN).parquet(f"{files.root}/{name}")
    return name, held, tuple(held.agg(*stats_of()).first())


def read(files: Files, run: Run) -> DataFrame:
    return files.spark.read.schema(RUN).parquet(f"{files.root}/{run.path}")


def read_all(files: Files, found: list[Run]) -> DataFrame:
    """The union of runs in one scan."""
    return files.spark.read.schema(RUN).parquet(*(f"{files.root}/{r.path}" for r in found)) if found else files.spark.createDataFrame([], RUN)
