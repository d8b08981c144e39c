"""The visible state of a history of puts and deletes: the latest row per key, unless it is a delete.

Deletes go only after the latest row is known, or older puts would come back. Conditions on the key go below the
aggregation, into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The row with the highest seq per key, deletes included. Partial aggregation makes a hot key one row per task."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.max_by("is_delete", "seq").alias("is_delete"))


def visible(log: DataFrame) -> DataFrame:
    return latest(log).filter(~F.col("is_delete")).select("key", "value")


def get(log: DataFrame, key: int) -> DataFrame:
    """At most one row (key, value). One global aggregate: a partial row per task, and no shuffle by key."""
    last = log.filter(F.col("key") == key).agg(F.max_by("value", "seq").alias("value"), F.max_by("is_delete", "seq").alias("is_delete"))
    return last.filter(~F.col("is_delete")).select(F.lit(key).cast("long").alias("key"), "value")


def scan(log: DataFrame, low: int, high: int) -> DataFrame:
    """Both ends belong to the range; an inverted range is empty. Rows come in ascending order of key."""
    return visible(log.filter(F.col("key").between(low, high))).orderBy("key")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Extension: the state after the write ``seq``."""
    return visible(log.filter(F.col("seq") <= seq))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key) with their values, null where there is none. The log is cut to the keys before it is aggregated."""
    wanted = keys.select("key").distinct()
    found = visible(log.join(wanted, "key", "left_semi"))
    return wanted.join(found, "key", "left")


#: Fixed value: levels of a 64-bit key space in which a cell is twice as wide as in the one before.
LEVELS = 64
#: Cells that may be broadcast.
MOST_CELLS = 200_000


def dyadic_cells(ranges: DataFrame) -> DataFrame:
    """Each range (low <= high) as disjoint cells (level, cell) of 2 ** level keys, two of a level at most: 126 for the widest range."""
    step = """aggregate(sequence(0, 63), struct(low AS lo, high AS hi, cast(array() AS array<struct<level: int, cell: bigint>>) AS cells), (s, l) -> struct(
        shiftright(s.lo, 1) + (s.lo & 1) AS lo,
        shiftright(s.hi, 1) - (1 - (s.hi & 1)) AS hi,
        concat(s.cells,
               if(s.lo <= s.hi AND (s.lo & 1) = 1, array(struct(l AS level, s.lo AS cell)), cast(array() AS array<struct<level: int, cell: bigint>>)),
               if(s.lo <= s.hi AND (s.hi & 1) = 0, array(struct(l AS level, s.hi AS cell)), cast(array() AS array<struct<level: int, cell: bigint>>))) AS cells), s -> s.cells)"""
    return ranges.filter("low <= high").select("range_id", F.explode(F.expr(step)).alias("c")).select("range_id", "c.level", "c.cell")


def multi_scan(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (range_id, low, high) with the entries in each. A range is cut into dyadic cells, however wide it is, and a key meets the cells it is in by
    an equality join, one at each level in use; so no range is compared with every key."""
    cells = dyadic_cells(ranges)
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    ends = ranges.filter("low <= high").agg(F.min("low"), F.max("high")).first()
    if not levels:
        return log.limit(0).select(F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"), "key", "value")
    if cells.count() <= MOST_CELLS:
        cells = F.broadcast(cells)
    near = log.filter(F.col("key").between(*ends))
    # all versions of a key are in the same cells, so the latest one is among those that meet a range
    at = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright("key", v).alias("cell")) for v in levels)))
    hit = near.withColumn("at", at).select("key", "value", "seq", "is_delete", "at.level", "at.cell").join(cells, ["level", "cell"])
    last = hit.groupBy("range_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("is_delete", "seq").alias("is_delete"))
    return last.filter(~F.col("is_delete")).select("range_id", "key", "value")


def merge(runs: list[DataFrame], drop_deletes: bool) -> DataFrame:
    """Runs as one, the latest row per key; deletes go where nothing older is left to hide."""
    log = runs[0]
    for run in runs[1:]:
        log = log.unionByName(run)
    out = latest(log)
    return out.filter(~F.col("is_delete")) if drop_deletes else out
