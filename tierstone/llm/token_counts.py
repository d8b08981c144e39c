"""Token counts as delta-maintained rollups.

A batch of changes holds signed rows: an insert adds a document's tokens to its source, language and tokenizer version, a delete takes
them away, a revision does both. ``commit`` adds the batch up and publishes the sums under the batch's id with one rename, so a batch
that is run again, or again after a crash, changes nothing. Totals are the sums over all published batches; ``compact`` folds batches
into one base, beside a table of the batches it holds. A reader never needs the documents again.

Edge cases: a null or empty text has no tokens but counts as a document; a very long text is tokenised whole; null source or language are
keys of their own; deleting what was never inserted gives negative totals, as the sums say; keys whose totals are all zero go;
repeated rows and ties count each; an empty table gives an empty batch, which is recorded and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import TOKENIZER, default_path, load
from .util import fresh_path, slices, texts_of, written

KEYS, SUMS = ["source", "lang", "tokenizer_version"], ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


def counted(docs: DataFrame, path: str | None = None, version: str = TOKENIZER, sign: int = 1, also: str | None = None) -> DataFrame:
    """Signed rows of ``docs`` (source, lang, text), already added up per task; ``also``: a column of integers to keep apart."""
    path = path or default_path()

    def run(batches):
        tokens, sums = load(path), {}
        for part in slices(batches, "text"):
            texts = [t or b"" for t in texts_of(part.column(2))]
            for *key, t, ids in zip(*(part.column(i).to_pylist() for i in others), texts, tokens.batch(texts)):
                s = sums.setdefault(tuple(key), [0, 0, 0])
                s[0] += 1
                s[1] += len(ids) // 4
                s[2] += len(t)
            if len(sums) > 100_000:
                yield batch(sums)
                sums = {}
        yield batch(sums)

    def batch(sums):
        rows = [(a, b, version, *(sign * x for x in s), *more) for (a, b, *more), s in sums.items()]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=names)

    names = [*KEYS, *SUMS, *([also] if also else [])]
    others = [0, 1, *([3] if also else [])]
    wanted = docs.select("source", "lang", "text", *([F.col(also).cast("long").alias(also)] if also else []))
    return wanted.mapInArrow(run, SCHEMA + (f", {also} long" if also else ""))


def signed(changes: DataFrame, sign: int) -> DataFrame:
    """Signed rows with their signs turned for ``sign`` = -1."""
    return changes.select(*KEYS, *((F.lit(sign) * F.col(c)).cast("long").alias(c) for c in SUMS))


def revised(old: DataFrame, new: DataFrame, path: str | None = None, version: str = TOKENIZER) -> DataFrame:
    """Signed rows that replace ``old`` documents by ``new`` ones."""
    return counted(old, path, version, -1).unionByName(counted(new, path, version))


class Rollup:
    """Totals kept under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _published(self) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.path)) if not (n := s.getPath().getName()).startswith((".", "_")))

    @staticmethod
    def _name(batch_id: str) -> str:
        return "batch-" + hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def _live(self) -> tuple[str | None, list[str]]:
        """The newest base, and the published batches that are not in it. Compaction bounds the number of these."""
        published = self._published()
        base = max((n for n in published if n.startswith("base-")), default=None)
        loose = [n for n in published if n.startswith("batch-")]
        if base and loose:
            held = {r[0] for r in self._held(base).filter(F.col("batch").isin(loose)).collect()}
            loose = [n for n in loose if n not in held]
        return base, loose

    def _held(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/batches")

    def committed(self, batch_id: str) -> bool:
        name, (base, loose) = self._name(batch_id), self._live()
        return name in loose or base is not None and not self._held(base).filter(F.col("batch") == name).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Publish a batch of signed rows; False if it was there already."""
        if self.committed(batch_id):
            return False
        temp = f".{uuid.uuid4().hex}"
        changes.groupBy(KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS)).write.parquet(f"{self.path}/{temp}")
        final = self._path(f"{self.path}/{self._name(batch_id)}")
        done = not self._fs.exists(final) and self._fs.rename(self._path(f"{self.path}/{temp}"), final)
        # some file systems move the loser of a race into the winner's folder, where its hidden name keeps it from being read; it has lost and goes
        inside = self._path(f"{self.path}/{self._name(batch_id)}/{temp}")
        if done and self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        if not done:
            self._fs.delete(self._path(f"{self.path}/{temp}"), True)
        return done

    def totals(self) -> DataFrame:
        base, loose = self._live()
        live = ([f"{base}/sums"] if base else []) + loose
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in live))
        out = rows.groupBy(KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        return out.filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold everything published into one base; batches in it stay known by id."""
        base, loose = self._live()
        if not loose:
            return
        temp = f"{self.path}/.{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([(n,) for n in loose], "batch string")
        if base:
            names = names.unionByName(self._held(base))
        self.totals().write.parquet(f"{temp}/sums")
        names.write.parquet(f"{temp}/batches")
        name = f"base-{int(base.split('-')[1]) + 1 if base else 0:09d}-{uuid.uuid4().hex[:8]}"
        self._fs.rename(self._path(temp), self._path(f"{self.path}/{name}"))
        for n in [*loose, *([base] if base else [])]:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)


#: Batches in which op3 inserts its documents.
BATCHES = 4


def op3(docs: DataFrame) -> DataFrame:
    """The totals of all documents, kept up through a life of changes: they come in ``BATCHES`` batches by a hash of doc_id, each committed twice; a
    source is deleted, the batches are folded, one language is revised to another, and both are undone. Texts are tokenised once."""
    spark = docs.sparkSession
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    dealt = docs.select("source", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).alias("batch"))
    rows = written(counted(dealt, also="batch"), "rollup-counts")
    insert = [rows.filter(F.col("batch") == i).drop("batch") for i in range(BATCHES)]
    for i in (*range(BATCHES), *range(BATCHES)):
        rollup.commit(f"insert-{i}", insert[i])
    source, lang = rows.agg(F.min("source"), F.max("lang")).first()
    of_source = rows.filter(F.col("source").eqNullSafe(F.lit(source))).drop("batch")
    old = rows.filter(F.col("lang").eqNullSafe(F.lit(lang))).drop("batch")
    new = old.withColumn("lang", F.lit("revised"))
    rollup.commit("delete", signed(of_source, -1))
    rollup.compact()
    rollup.commit("revise", signed(old, -1).unionByName(new))
    rollup.commit("insert-0", insert[0])
    rollup.commit("insert again", of_source)
    rollup.commit("revise back", signed(new, -1).unionByName(old))
    rollup.compact()
    return rollup.totals()
