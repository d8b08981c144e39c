"""The store: put, delete, get and scan by key, and the same over whole DataFrames.

A single key is a driver call or one small job; throughput comes from put_all, delete_all, multi_get and multi_scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import state
from .memtable import Memtable
from .plans.policy import Policy, make_room, recency
from .schema import LARGEST, RESERVED, RUN, check, checked, deletes, puts
from .sources import manifest as M
from .sources import runs as R
from .sources.manifest import Config, Run

ENTRY_BYTES, PAGE_BYTES = 16, 4096


class Store:
    """``with Store.open(spark, path) as s: ...``; closing flushes. Using a closed store raises."""

    def __init__(self, spark: SparkSession, path: str, manifest: M.Manifest, files: M.Files) -> None:
        self.spark, self.path, self._manifest, self._files = spark, path, manifest, files
        self._memtable, self._open = Memtable(), True

    @classmethod
    def open(cls, spark: SparkSession, path: str, **config) -> "Store":
        """Open or create; ``config`` (fields of Config) replaces stored settings."""
        if not path or not path.strip():
            raise ValueError("a store needs a name")
        files = M.Files(spark, path)
        fresh = not files.exists()
        if fresh:
            files.make()
        found = M.load(files)
        if found is None:
            if not fresh and files.names():
                raise ValueError(f"{path} exists and is not a store")
            found = M.Manifest()
        store = cls(spark, path, found, files)
        store.configure(**config)
        if found.version == 0:
            M.save(files, found)
        return store

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _check_open(self) -> None:
        if not self._open:
            raise RuntimeError("the store is closed")

    def close(self) -> None:
        if self._open:
            self.flush()
            M.save(self._files, self._manifest)
            self._open = False

    @property
    def name(self) -> str:
        return self.path

    @property
    def config(self) -> Config:
        return self._manifest.config

    @property
    def levels(self) -> list[list[Run]]:
        return self._manifest.levels

    def configure(self, **settings) -> "Store":
        """Settings hold for runs written from now on. ``*_mb`` forms give sizes in MB."""
        for k in [k for k in settings if k.endswith("_mb")]:
            mb = settings.pop(k)
            settings[k[:-3]] = mb * 2**20 // (ENTRY_BYTES if k.startswith("memtable") else PAGE_BYTES)
        unknown = set(settings) - set(vars(self.config))
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        self._manifest.config = Config(**(vars(self.config) | settings)).check()
        return self

    def run_count(self, level: int) -> int:
        return len(self.levels[level]) if level < len(self.levels) else 0

    def run_total(self) -> int:
        return sum(map(len, self.levels))

    def _seq(self) -> int:
        self._manifest.next_seq += 1
        return self._manifest.next_seq - 1

    def _write(self, key: int, value: int | None) -> None:
        self._check_open()
        if len(self._memtable) >= self.config.memtable_capacity:
            self.flush()  # a full memtable goes first, also when the key only replaces one in it
        self._memtable.put(key, value, self._seq())

    def put(self, key: int, value: int) -> None:
        self._write(check(key, "key"), check(value, "value"))

    def delete(self, key: int) -> None:
        """Deleting an absent key is allowed."""
        self._write(check(key, "key"), None)

    def _add_run(self, rows: DataFrame, stats: tuple) -> None:
        levels = self.levels
        make_room(levels, Policy(self.config.compaction_policy), self.config.sst_size_ratio, self.config.memtable_capacity, self._merge)
        run = R.write(self._files, rows, self.config, stats[0], stats)
        if run is not None:
            levels[0].append(run)
        M.save(self._files, self._manifest)

    def flush(self) -> None:
        self._check_open()
        if len(self._memtable):
            rows = self._memtable.rows()
            keys = [r[0] for r in rows]
            self._add_run(self.spark.createDataFrame(rows, RUN), (len(rows), min(keys), max(keys), max(r[2] for r in rows)))
            self._memtable.clear()

    def _merge(self, found: list[Run], drop_deletes: bool) -> Run | None:
        rows = state.merge([R.read(self._files, r) for r in found], drop_deletes)
        return R.write(self._files, rows, self.config, sum(r.entries for r in found))

    def put_all(self, df: DataFrame, order: str | None = None) -> None:
        """Upsert ``df`` (key, value) as one run. Of equal keys the row with the largest ``order`` stays, then the one with the largest value."""
        self.flush()
        by = F.struct(*([F.col(order)] if order else []), F.col("value"))
        best = df.groupBy("key").agg(F.max_by("value", by).alias("value"), F.count_if(F.col("value").isNull()).alias("__nulls"))
        # a null would lose against any value, so it is kept to be refused
        self._bulk(puts(best.withColumn("value", F.when(F.col("__nulls") == 0, F.col("value"))), self._seq()))

    def delete_all(self, df: DataFrame) -> None:
        """Delete every key of ``df`` (key)."""
        self.flush()
        self._bulk(deletes(df, self._seq()).distinct())

    def write_log(self, changes: DataFrame) -> None:
        """Add ``changes`` (key, value, seq, is_delete) as one run with their own order: the highest seq of a key counts, whenever it comes. Only a delete
        that a merge of the last level has dropped can no longer hide an older put that comes after it."""
        self.flush()
        last = state.latest(changes).withColumn("value", F.when(~F.col("is_delete"), checked("value")))
        self._bulk(last.select(checked("key").alias("key"), "value", "seq", "is_delete"))

    def _bulk(self, rows: DataFrame) -> None:
        name, held, stats = R.spool(self._files, rows)
        if stats[0]:
            self._manifest.next_seq = max(self._manifest.next_seq, stats[3] + 1)
            self._add_run(held, stats)
        self._files.delete(name)

    def log(self, low: int = RESERVED, high: int = LARGEST) -> DataFrame:
        """The history that may hold keys of a range: runs whose keys reach into it, and the memtable."""
        self._check_open()
        found = [r for r in recency(self.levels) if r.max_key >= low and r.min_key <= high]
        mem = self._memtable.scan(low, high)
        rows = R.read_all(self._files, found)
        return rows.unionByName(self.spark.createDataFrame(mem, RUN)) if mem else rows

    def get(self, key: int) -> int | None:
        self._check_open()
        held = self._memtable.get(key)
        if held is not None:
            return held[0]
        if not any(r.min_key <= key <= r.max_key for r in recency(self.levels)):
            return None
        row = state.get(self.log(key, key), key).first()
        return None if row is None else row["value"]

    def scan(self, low: int, high: int) -> DataFrame:
        """Entries with low <= key <= high, ascending; lazy."""
        return state.scan(self.log(low, high), low, high)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return state.multi_get(self.log(), keys)

    def multi_scan(self, ranges: DataFrame) -> DataFrame:
        return state.multi_scan(self.log(), ranges)

    def vacuum(self, older_than: float = 7 * 24 * 3600) -> list[str]:
        """Delete runs that merges have replaced, so many seconds after they were written. Scans taken before a merge read them until then."""
        self._check_open()
        return M.vacuum(self._files, self._manifest, older_than)
