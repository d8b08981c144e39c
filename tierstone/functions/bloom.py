"""A Bloom filter as a table of set bits.

Stores use Parquet's own Bloom filters (see sources.runs); this form is for queries over membership itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_functions(bits_per_entry: int) -> int:
    return max(1, math.ceil(bits_per_entry * math.log(2)))


def filter_bytes(entries: int, bits_per_entry: int) -> int:
    return -(-entries * bits_per_entry // 8)


def positions(key: Column, bits: int, k: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(k)))


def build(keys: DataFrame, entries: int, bits_per_entry: int) -> DataFrame:
    """The distinct set bits (bit)."""
    if bits_per_entry < 1:
        raise ValueError("bits_per_entry must be at least 1")
    bits = max(8, filter_bytes(entries, bits_per_entry) * 8)
    return keys.select(F.explode(positions(F.col("key"), bits, hash_functions(bits_per_entry))).alias("bit")).distinct()


def contains(keys: DataFrame, built: DataFrame, entries: int, bits_per_entry: int) -> DataFrame:
    """The distinct ``keys`` all of whose bits are set: no member is missed."""
    bits, k = max(8, filter_bytes(entries, bits_per_entry) * 8), hash_functions(bits_per_entry)
    asked = keys.select("key").distinct().select("key", F.explode(F.array_distinct(positions(F.col("key"), bits, k))).alias("bit"))
    hit = asked.join(built.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg(F.bool_and(F.col("set").isNotNull()).alias("all")).filter("all").select("key")
