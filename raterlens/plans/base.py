"""Registry of the named queries and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
frames Spark derives from them). Outputs go through :func:`tidy`: integral
columns become BIGINT and doubles are rounded to 6 digits, so results compare
exactly with the oracle SQL (which casts and rounds the same way).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL over the
    driver tables (omit for queries that have no exact SQL form)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def round6(c):
    """Round a double to 6 digits as ``round(x * 1e6) / 1e6`` with halves
    away from zero on the binary product - the rule SQL engines such as
    DuckDB apply - instead of Spark's decimal-string HALF_UP, so exact ties
    (e.g. 333/640) round the same way on both sides. No BIGINT cast, so no
    overflow for large values."""
    x = c.cast("double")
    a = F.abs(x) * F.lit(1e6)
    r = F.rint(a)
    r = F.when(a - r == F.lit(0.5), r + F.lit(1.0)).otherwise(r)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.signum(x) * r / F.lit(1e6))


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INTEGRAL):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round6(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
