"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (one and two words), one of all texts and one of the target texts: documents labelled good, of
which at most about ``MAX_TARGET`` are used, chosen by a hash of doc_id; that is the only sample, and its ids alone are broadcast, so texts
stay where they are. A document's log weight is the sum of its n-grams' log ratios. Sampling without replacement in
proportion to the weights is taking the k largest of log weight + Gumbel noise. The noise is a seeded hash of doc_id; k is the share of good
ones among the labelled documents (or ``share``), of all documents. The k-th largest is found by histograms of the ordered keys, 4096 counts at a
time, so nothing is sorted or gathered.

Edge cases: a null, empty or all-white text has weight null and is not taken; a very long text is read whole; keys equal to the k-th are
all taken; without labels everything with words is taken; null or repeated labels of a document: it is good if any label is 1; repeated rows
are judged alike and each counts; a null doc_id has no label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checked_broadcast, mix64, slices, texts_of, written

BUCKETS, SMOOTH, SEED = 10_000, 1.0, "gumbel-1"
#: About so many documents labelled good fit the target model (all of them, where there are fewer).
MAX_TARGET = 100_000


def grams(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The bucket of every one- and two-word n-gram."""
    words = (text or b"").lower().split()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _trim(known: dict) -> dict:
    return {} if len(known) > 300_000 else known


def targets(labels: DataFrame, most: int = MAX_TARGET) -> tuple[DataFrame, int]:
    """The ids (__good) of the target documents, and their number."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good")).distinct()
    n = good.count()
    if n > most:
        good = good.filter(F.pmod(F.xxhash64("__good", F.lit("target")), F.lit(1 << 30)) < int(most / n * (1 << 30)))
        good = written(good, "importance-targets")
        n = good.count()
    return good, n


def models(docs: DataFrame, labels: DataFrame, most: int = MAX_TARGET) -> np.ndarray:
    """Log ratio of target to raw per bucket. Each task adds up its own counts; 2 x BUCKETS sums reach the driver."""
    good, n = targets(labels, most)
    both = docs.select("doc_id", "text").join(checked_broadcast(good, n, 2 * most), F.col("doc_id") == F.col("__good"), "left").select("text", F.col("__good").isNotNull().alias("good"))

    def run(batches):
        counts, known = np.zeros((2, BUCKETS), np.int64), {}
        for part in slices(batches):
            known = _trim(known)
            for t, g in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                n = np.bincount(grams(t, known), minlength=BUCKETS)
                counts[0] += n
                if g:
                    counts[1] += n
        kind, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[kind, bucket])], names=["kind", "bucket", "n"])

    total = np.zeros((2, BUCKETS))
    for kind, bucket, n in both.mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n")).collect():
        total[kind, bucket] = n
    logs = np.log(total + SMOOTH) - np.log(total.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return logs[1] - logs[0]


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight and gumbel_key."""

    def run(batches):
        known: dict = {}
        for part in slices(batches, "text"):
            known = _trim(known)
            weights = [float(ratio[g].sum()) if len(g := grams(t, known)) else None for t in texts_of(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weights, pa.float64())], names=["doc_id", "log_weight"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value of a double column; None if there are fewer. Each round splits the range that holds it into 4096 counts."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None
    left = k
    while True:
        part = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / 4096
        # neighbouring doubles are one count each; else a part of the range
        place = F.col("v") if low + width <= low else F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(4095))
        counts = part.groupBy(place.alias("place")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        for _, lo, hi, n in sorted(counts.collect(), key=lambda r: -r["lo"]):
            if left <= n:
                break
            left -= n
        else:
            return None
        if lo == hi:
            return lo
        low, high = lo, hi


def op9(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    if share is None:
        n, good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).agg(F.count("*"), F.sum(F.when(F.col("q") == 1, 1).otherwise(0))).first()
        share = good / n if n else 1.0
    scored = written(weigh(docs, models(docs, labels)), "importance")
    k = round(share * scored.count())
    limit = kth_largest(scored, "gumbel_key", k) if k else float("inf")
    kept = F.coalesce(F.col("gumbel_key") >= F.lit(float("-inf") if limit is None else limit), F.lit(False))
    return scored.withColumn("kept", kept)
