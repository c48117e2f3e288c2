"""Exact distinct counts of several columns in one pass, without multiplying
the rows.

Integers set bits of bitmaps: a value's bucket is one small binary buffer, which
tasks fill for their own rows and unite by bucket, so any number of columns
costs one row each for every bucket they touch. Strings are counted by distinct
values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def bitmap_distinct(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """One row: for each entry (name: integer column or expression) the number
    of its distinct non-null values. Dense ids (0 up) fill their buckets."""
    parts = None
    for name, c in columns.items():
        v = (F.col(c) if isinstance(c, str) else c).cast("bigint")
        one = df.select(F.lit(name).alias("name"), v.alias("v")).filter(F.col("v").isNotNull())
        one = one.groupBy("name", F.bitmap_bucket_number("v").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
        parts = one if parts is None else parts.unionByName(one)
    per = parts.select("name", F.bitmap_count("bits").alias("n"))
    return per.agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in columns])


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: distinct non-null values of each column, integers by bitmaps,
    others by one distinct aggregate each."""
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = {c: c for c in columns if isinstance(kinds[c], _INTEGRAL)}
    out = bitmap_distinct(df, numbers) if numbers else df.sparkSession.range(1).drop("id")
    for c in columns:
        if c not in numbers:
            n = df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()
            out = out.withColumn(c, n)
    return out.select(*columns)
