"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters (``repartitionByRange``) deal the normalised texts into ranges by their first code points and, behind these, a
hash, so that the sampled keys are short; an external sort puts equal texts side by side, and a sort aggregate compares each with its
neighbour in full and keeps the first row by (most code points, smallest doc_id).
A text with very many copies spans several ranges: copies of a text over ``HOT_ROWS`` (known from a count of
digests, so at most rows / HOT_ROWS texts) get a salt as the last range key, and the digest stitches the pieces' one row each.

Edge cases: a null text counts as empty; empty and all-white texts form one group; a null doc_id comes after all others; of
rows that are alike in everything one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checked_broadcast, with_row_id, written

WHITE = " \t\n\x0b\x0c\r"
#: A text with more copies than this, and than one row in 1000, is dealt to several ranges.
HOT_ROWS = 500
#: Code points of a text that its range key holds; the driver samples range keys, which must not be whole texts.
HEAD = 32


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, row id, code points, normalised text and its digest; written once."""
    text = F.coalesce("text", F.lit(""))
    norm = F.translate(text, WHITE, "")
    return with_row_id(docs.select("doc_id", F.char_length(text).alias("chars"), norm.alias("norm")).withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256)), "exact")


def groups(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """text_sha256, group_size and ``best`` (the row that stays) of each text that occurs more than once."""
    n = rows.count()
    limit = max(hot_rows, n // 1000)
    hot = written(rows.groupBy("text_sha256").count().filter(F.col("count") > limit).select(F.col("text_sha256").alias("__sha"), F.ceil(F.col("count") / limit).alias("__pieces")), "exact-hot")
    salt = F.coalesce(F.pmod(F.xxhash64("__rid"), F.col("__pieces")), F.lit(0))
    salted = rows.join(checked_broadcast(hot, n // limit, 1000), F.col("text_sha256") == F.col("__sha"), "left").select(F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("rest"), salt.alias("salt"), "norm", "text_sha256", F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "__rid").alias("row"))
    # the range exchange clusters on a subset of the grouping keys, so no second exchange follows
    same = salted.repartitionByRange("head", "rest", "salt").groupBy("head", "rest", "salt", "norm").agg(F.first("text_sha256").alias("text_sha256"), F.min("row").alias("best"), F.count("*").alias("n"))
    return same.groupBy("text_sha256").agg(F.min("best").alias("best"), F.sum("n").alias("group_size")).filter("group_size > 1")


def decide(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each row with keep_id, group_size and kept. The join moves ids and digests, not texts; AQE splits hot digests."""
    # written, so that both sides of the join are plain scans, which AQE can split at a hot digest
    twice = written(groups(rows, hot_rows).select(F.col("text_sha256").alias("__sha"), "best", "group_size"), "exact-groups")
    out = rows.select("doc_id", "__rid", "text_sha256").join(twice, F.col("text_sha256") == F.col("__sha"), "left")
    alone = F.col("best").isNull()
    return out.select(
        "doc_id", "__rid",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.__rid") == F.col("__rid"))).alias("kept"),
        "text_sha256",
    )


def op5(docs: DataFrame) -> DataFrame:
    return decide(prepared(docs)).drop("__rid")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, in their own columns."""
    text = F.coalesce("text", F.lit(""))
    rows = with_row_id(docs, "exact-docs")
    norm = rows.select("doc_id", "__rid", F.char_length(text).alias("chars"), F.translate(text, WHITE, "").alias("norm"))
    decided = decide(written(norm.withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256)), "exact-norm"))
    gone = written(decided.filter(~F.col("kept")).select("__rid"), "exact-gone")
    return rows.join(checked_broadcast(gone, gone.count(), 1_000_000), "__rid", "left_anti").select(docs.columns)


SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
