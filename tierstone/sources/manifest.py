"""A store's manifest: configuration and levels as JSON, replaced by one rename."""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..plans.policy import Policy


@dataclass
class Run:
    path: str
    entries: int
    min_key: int
    max_key: int
    max_seq: int
    bloom: bool = False
    layout: str = "array"


@dataclass
class Config:
    """Settings whose effect Spark takes over (search algorithm, buffer pool) are kept and never change an answer: Parquet's page index and row group
    statistics do the searching, and pages are cached by the file system and, where a caller persists a scan, by Spark."""

    memtable_capacity: int = 256
    sst_size_ratio: int = 2
    sst_implementation: str = "array"
    sst_search_algorithm: str = "default"
    enable_buffer_pool: bool = True
    buffer_pool_capacity: int = 2560
    buffer_pool_initial_size: int = 97
    compaction_policy: str = Policy.NONE.value
    enable_bloom_filter: bool = True
    bloom_filter_bits_per_entry: int = 5

    def check(self) -> "Config":
        for name, least in (("memtable_capacity", 1), ("sst_size_ratio", 2), ("buffer_pool_capacity", 1), ("buffer_pool_initial_size", 1), ("bloom_filter_bits_per_entry", 1)):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < least:
                raise ValueError(f"{name} must be an integer of at least {least}")
        if self.sst_implementation not in ("array", "btree") or self.sst_search_algorithm not in ("default", "binary_search"):
            raise ValueError("unknown SST implementation or search algorithm")
        Policy(self.compaction_policy)
        return self


@dataclass
class Manifest:
    config: Config = field(default_factory=Config)
    levels: list[list[Run]] = field(default_factory=lambda: [[]])
    next_seq: int = 1
    version: int = 0


class Files:
    """The few file system calls a store needs, by Hadoop's API, so a path may be on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]

    def ages(self) -> list[tuple[str, float]]:
        """Names with the seconds since they were written."""
        now = time.time()
        return [(s.getPath().getName(), now - s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(""))]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def publish(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f".{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._path(f".{name}"), self._path(name)):
            raise RuntimeError(f"{name} exists: another writer has the store open")


_NAME = re.compile(r"manifest-(\d{12})\.json\Z")


def load(files: Files) -> Manifest | None:
    versions = sorted(m[0] for n in files.names() if (m := _NAME.match(n)))
    if not versions:
        return None
    x = json.loads(files.read(versions[-1]))
    return Manifest(Config(**x["config"]), [[Run(**r) for r in level] for level in x["levels"]], x["next_seq"], x["version"])


def save(files: Files, manifest: Manifest) -> None:
    """Publish the next version; older ones but the last go. Runs stay, for readers that hold them and writers that have not published them yet."""
    manifest.version += 1
    files.publish(f"manifest-{manifest.version:012d}.json", json.dumps(asdict(manifest)))
    for n in files.names():
        m = _NAME.match(n)
        if m and int(m[1]) < manifest.version - 1:
            files.delete(n)


def vacuum(files: Files, manifest: Manifest, older_than: float) -> list[str]:
    """Delete runs (and spools) that the manifest does not name and that are older than so many seconds."""
    live = {r.path for level in manifest.levels for r in level}
    gone = [n for n, age in files.ages() if n.startswith(("run-", ".spool-")) and n not in live and age >= older_than]
    for n in gone:
        files.delete(n)
    return gone
