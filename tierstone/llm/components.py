"""Connected components by alternating large-star and small-star steps, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, written

#: Links that a task turns into stars at once.
LINKS = 1 << 20


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component, from links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up


def _local_stars(batches):
    """Some links of a partition at a time as stars around the smallest key."""

    def stars(held):
        a, b = (pa.chunked_array(x).combine_chunks() for x in zip(*held))
        both = pa.concat_arrays([a, b]).dictionary_encode()
        keys, at = both.dictionary, np.asarray(both.indices)
        order = np.asarray(pa.compute.sort_indices(keys))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[at]
        root = local_components(at[: len(a)], at[len(a) :], len(order))
        far = np.flatnonzero(root != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(order[far])), keys.take(pa.array(order[root[far]]))], names=["a", "b"])

    import pyarrow.compute  # noqa: F401

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0), batch.column(1)))
        n += batch.num_rows
        if n > LINKS:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is a root or hangs on one root by its only edge: then each component is a star around its smallest key."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg((F.sum("up") + F.max("down")).alias("n")).filter("n > 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """node, root (the smallest key of its component) for every node of ``links`` (a, b of one type, binary or long). What a step joins is written
    first, so that both sides are plain scans, which AQE can split at a node with very many links."""
    kind = links.schema["a"].dataType.simpleString().replace("bigint", "long")
    edges = written(links.select("a", "b").mapInArrow(_local_stars, f"a {kind}, b {kind}").distinct(), "cc")
    while not _all_stars(edges):
        # an edge (a, b) has b < a
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "cc-least")
        large = written(edges.join(least, F.col("b") == F.col("node")).select(F.col("a").alias("u"), F.col("m").alias("w")).distinct(), "cc-large")
        small = written(large.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("node"), "m"), "cc-small")
        stars = large.join(small, F.col("u") == F.col("node")).filter("w > m").select(F.col("w").alias("a"), F.col("m").alias("b"))
        last = edges
        edges = written(stars.unionByName(small.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "cc")
        discard(last, least, large, small)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
