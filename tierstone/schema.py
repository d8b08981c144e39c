"""The run schema, reserved values and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The smallest 64-bit integer is neither a key nor a value.
RESERVED, LARGEST = -(2**63), 2**63 - 1

RUN = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("value", T.LongType()), T.StructField("seq", T.LongType(), False), T.StructField("is_delete", T.BooleanType(), False)])
ENTRY = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("value", T.LongType())])


def check(number: int, what: str) -> int:
    if not isinstance(number, int) or isinstance(number, bool) or not RESERVED < number <= LARGEST:
        raise ValueError(f"{what} must be a 64-bit integer above {RESERVED}: {number!r}")
    return number


def checked(column: str) -> Column:
    """The column as a long; null or the reserved value fails the job."""
    c = F.col(column).cast("long")
    return F.when(c.isNull() | (c == F.lit(RESERVED)), F.raise_error(F.lit(f"{column} is null or the reserved value")).cast("long")).otherwise(c)


def puts(df: DataFrame, seq: int) -> DataFrame:
    return df.select(checked("key").alias("key"), checked("value").alias("value"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("is_delete"))


def deletes(df: DataFrame, seq: int) -> DataFrame:
    return df.select(checked("key").alias("key"), F.lit(None).cast("long").alias("value"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("is_delete"))
