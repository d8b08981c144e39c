"""Pages, fences, ranks and the geometry of a page tree, as columns and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PAGE_BYTES, ENTRY_BYTES, POINTER_BYTES = 4096, 16, 8
PER_PAGE, FANOUT = PAGE_BYTES // ENTRY_BYTES, PAGE_BYTES // POINTER_BYTES


def pages(entries: int) -> int:
    return -(-entries // PER_PAGE)


def tree_depth(entries: int) -> int:
    """Levels of inner nodes over the leaves."""
    depth, reach, leaves = 0, 1, pages(entries)
    while reach < leaves:
        depth, reach = depth + 1, reach * FANOUT
    return depth


def nodes_at(depth: int, entries: int) -> int:
    return -(-pages(entries) // FANOUT ** (tree_depth(entries) - depth))


def leaves_below(depth: int, entries: int) -> int:
    return FANOUT ** (tree_depth(entries) - depth)


def first_page_at(depth: int, entries: int) -> int:
    return sum(nodes_at(d, entries) for d in range(depth))


def node_page(depth: int, node: int, entries: int) -> int:
    return first_page_at(depth, entries) + node


def subtree_height(depth: int, entries: int) -> int:
    """Levels of nodes from a node at ``depth`` down to its leaves."""
    return tree_depth(entries) - depth


def node_byte(depth: int, node: int, entries: int) -> int:
    """Where a node's page begins in a file of pages from the root down."""
    return node_page(depth, node, entries) * PAGE_BYTES


def seek(index: int, entries: int) -> tuple[int, int]:
    """(page, byte in the page) of an entry's index."""
    if not 0 <= index < entries:
        raise ValueError(f"no entry {index} among {entries}")
    return index // PER_PAGE, index % PER_PAGE * ENTRY_BYTES


def tree_shape(sizes: DataFrame) -> DataFrame:
    """``sizes`` (entries) with pages, depth and inner nodes, for trees of up to four levels."""
    leaves = F.ceil(F.col("entries") / PER_PAGE)
    level = [F.ceil(leaves / FANOUT**d) for d in range(1, 5)]
    depth = sum((F.when(leaves > F.lit(FANOUT**d), 1).otherwise(0) for d in range(4)), F.lit(0))
    inner = sum((F.when(depth >= d + 1, level[d]).otherwise(0) for d in range(4)), F.lit(0))
    return sizes.select("entries", leaves.cast("long").alias("n_pages"), depth.cast("long").alias("depth"), inner.cast("long").alias("inner_nodes"))


def place(index: Column) -> Column:
    """(page, offset) of an entry's index."""
    return F.struct(F.floor(index / PER_PAGE).alias("page"), (index % PER_PAGE).alias("offset"))


def ranked(entries: DataFrame) -> DataFrame:
    """``entries`` with the 0-based ``index`` of each key in ascending order. Sampled splitters deal the keys into sorted ranges, written once; a row's
    place in its range is known from the write, and only the ranges' counts meet in one task."""
    dealt = written(entries.repartitionByRange("key").sortWithinPartitions("key").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # one row per task of the write
    return dealt.join(F.broadcast(before), part == F.col("__part")).withColumn("index", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).drop("__at", "__part", "__before")


def fences(entries: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """The last key of each page."""
    return ranked(entries).groupBy(F.floor(F.col("index") / per_page).alias("page")).agg(F.max("key").alias("fence"), F.count("*").alias("n"))


def bounds(entries: DataFrame, probe: int) -> DataFrame:
    """leftmost: how many keys are below ``probe``; rightmost: the last index at or below it, -1 if none."""
    return entries.agg(F.count_if(F.col("key") < probe).alias("leftmost"), (F.count_if(F.col("key") <= probe) - 1).alias("rightmost"))
