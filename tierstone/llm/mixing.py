"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share 150 % of all words. A source is clamped at
``MAX_EPOCHS`` times its size and the rest is shared anew by weight: the fixed point is ``min(cap, level * weight)``, and the level
follows from sums over the sources in order of ``cap / weight``. A source then takes every document ``whole`` times and, in the seeded order
of an md5 of doc_id and text, one time more as long as half of the document lies within the target. Where that order ends is
found from sums over 4096 parts of the md5 range, and a running sum over the distinct places inside one part.

Rows that agree in doc_id and text share a place. They are counted before anything is ordered, so any number of them is one row, and the
part of them that is taken once more goes by row number, found from counts per written partition.

Edge cases: null and empty texts have size 0; a very long text is one document and is never cut; a null source is a source of its own,
the last; null and repeated doc_ids are rows like others; of rows that tie in doc_id and text as many are taken as come nearest to
the target; with no words all targets are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import checked_broadcast, with_row_id, written

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def same() -> Column:
    return F.col("source").eqNullSafe(F.col("__source"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with __size and the seeded place __key."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__key", F.md5(key.cast("binary")))


def targets(sizes: DataFrame) -> DataFrame:
    """A row per source: __source, source_size, target, whole (times each document is taken) and rest (words to take once more)."""
    per = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    in_order, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"cap": F.col("source_size") * MAX_EPOCHS, "total": F.sum("source_size").over(all_rows) * F.lit(SHARE)})
    per = per.withColumns({"before": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "open": F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # the level if this source and all after it are open; the first source below its cap sets the level
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("before").alias("b"), F.col("level").alias("l")))).over(all_rows)["l"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    per = per.withColumn("target", target)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(0).cast("long"))
    return per.select(F.col("source").alias("__source"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def plan(sizes: DataFrame) -> DataFrame:
    """targets() with ``last``: the place (__key, row number) up to which documents are taken once more; null: none. ``sizes`` has __rid, from with_row_id()."""
    per = written(targets(sizes), "mix-sources")
    part = F.substring("__key", 1, 3)
    sums = sizes.groupBy("source", part.alias("part")).agg(F.sum("__size").alias("words"))
    sums = sums.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    # half of a document may lie beyond the target: the last part that may hold the end is the last that starts before it
    ends = sums.join(per, same()).filter("start < rest").groupBy("source").agg(F.max(F.struct("part", "start", "rest")).alias("e"))
    ends = written(ends.select(F.col("source").alias("__source"), "e.part", "e.start", "e.rest"), "mix-ends")
    # a place is as many rows as agree in doc_id and text, and they have one size; a hash collision of places would only move a few words
    inside = sizes.join(ends, same() & (part == F.col("part"))).groupBy("source", "__key").agg(F.max("__size").alias("z"), F.count("*").alias("n"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.coalesce(F.sum(F.col("z") * F.col("n")).over(before), F.lit(0)) + F.col("start"))
    # how many rows of the place have their middle within the target; the quotient may round, so its neighbours are tried
    fits = lambda m: F.col("at") + m * F.col("z") - F.col("z") / 2 <= F.col("rest")
    guess = F.floor((F.col("rest") - F.col("at")) / F.nullif(F.col("z"), F.lit(0)) + 0.5)
    many = F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(guess - 1)
    taken = F.when(F.col("z") == 0, F.when(fits(F.lit(1)), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), many))).cast("long")
    last = inside.withColumn("m", taken).filter("m > 0").groupBy("source").agg(F.max(F.struct("__key", "m", "n")).alias("l"))
    last = last.select(F.col("source").alias("__s"), F.col("l.__key").alias("__k"), "l.m", "l.n")
    # a place of which only some rows are taken: the m-th of its row numbers, from counts by written partition and an order within one
    cut = sizes.join(F.broadcast(last.filter("m < n")) if per.count() <= 100_000 else last.filter("m < n"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k"))).select("source", "m", "__rid", F.shiftright("__rid", 33).alias("task"))
    tasks = cut.groupBy("source", "task").agg(F.count("*").alias("c"), F.first("m").alias("m"))
    tasks = tasks.withColumn("upto", F.sum("c").over(Window.partitionBy("source").orderBy("task"))).filter("upto >= m AND upto - c < m")
    tasks = tasks.select(F.col("source").alias("__source"), F.col("task").alias("__task"), (F.col("m") - F.col("upto") + F.col("c")).alias("nth"))
    order = Window.partitionBy("source").orderBy("__rid")
    stop = cut.join(tasks, same() & (F.col("task") == F.col("__task"))).withColumn("i", F.row_number().over(order)).filter("i = nth").select(F.col("source").alias("__c"), F.col("__rid").alias("stop"))
    # no document of the last part fits: everything before that part is taken
    floor = ends.select(F.col("__source").alias("__f"), F.struct(F.col("part").alias("key"), F.lit(-1).cast("long").alias("rid")).alias("floor"))
    out = per.join(floor, F.col("__source").eqNullSafe(F.col("__f")), "left").join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").join(stop, F.col("__source").eqNullSafe(F.col("__c")), "left")
    found = F.when(F.col("__k").isNotNull(), F.struct(F.col("__k").alias("key"), F.coalesce("stop", F.lit(2**63 - 1)).alias("rid")))
    return written(out.select("__source", "source_size", "target", "whole", F.coalesce(found, "floor").alias("last")), "mix-plan")


def copied(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (source, __key, __rid, __size and others) with source_size, target and __copies. The sources' plan is broadcast where it has few rows, so
    texts stay where they are."""
    per = plan(sizes)
    more = F.coalesce((F.struct(F.col("__key").alias("key"), F.col("__rid").alias("rid")) <= F.col("last")) & (F.col("whole") < MAX_EPOCHS), F.lit(False))
    return rows.join(checked_broadcast(per, per.count(), 100_000), same()).withColumn("__copies", F.col("whole") + more.cast("long"))


def op8(docs: DataFrame) -> DataFrame:
    sizes = with_row_id(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes", "__rid")
    return copied(sizes, sizes).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = with_row_id(sized(docs.select("doc_id", "source", F.struct(*docs.columns).alias("__row"), "text")).drop("text"), "mix-rows", "__rid")
    out = copied(rows, rows.drop("__row"))
    return out.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap,
             (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM p),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM w),
l AS (SELECT *, (total - before) / open AS lev FROM f),
m AS (SELECT arg_min(lev, before) AS lev FROM l WHERE lev * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(m.lev * weight, cap::DOUBLE)) AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.whole, target - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN whole < 2 AND rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r
"""
