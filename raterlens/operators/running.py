"""Running totals and exact quantiles without a window over a whole group.

A range-partitioned order is written once; totals run inside its partitions
and are shifted by the totals of the partitions before (a table of at most
partitions x groups rows). Quantiles are read off the running counts of the
distinct values, which run inside buckets of the values' order and are shifted
by the buckets before, so no task holds a group's values and nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raterlens.session import cut_lineage

# Buckets of doubles: PER_OCTAVE for each power of two from LEAST up.
PER_OCTAVE, LOG_SHIFT, LEAST = 64, 1074, 2.0 ** -1074


def running_totals(df: DataFrame, order: Sequence[tuple[str, bool]], totals: dict[str, Column],
                   group: Sequence[str] = ()) -> DataFrame:
    """Adds, for each ``totals`` entry, the sum of its expression over the rows
    of the group up to and including this one, in the order given as (column,
    ascending) pairs; the order must be unique inside a group."""
    group = list(group)
    keys = [*group, *[F.col(c).asc() if up else F.col(c).desc() for c, up in order]]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select("*", *[e.alias(f"__v_{c}") for c, e in totals.items()])
    d = cut_lineage(d.repartitionByRange(n_parts, *keys).withColumn("__pid", F.spark_partition_id()))
    inside = W.partitionBy("__pid", *group).orderBy(*keys[len(group):]).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("__pid", *group).agg(*[F.sum(f"__v_{c}").alias(f"__s_{c}") for c in totals])
    offsets = sums.select(F.col("__pid").alias("__opid"), *[F.col(g).alias(f"__g_{g}") for g in group],
                          *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in totals])
    on = F.col("__pid") == F.col("__opid")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = d.select("*", *[F.sum(f"__v_{c}").over(inside).alias(f"__r_{c}") for c in totals])
    return out.join(F.broadcast(offsets), on).select(
        *df.columns, *[(F.col(f"__r_{c}") + F.col(f"__o_{c}")).alias(c) for c in totals])


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles, linearly interpolated, of the non-null values of each
    group: one row per group with a value, one column per ``probs`` entry.
    Groups match their nulls (join on them null-safely)."""
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).alias("__c"))
    run = _upto(counts, group)
    cols = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
            cols.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{side}_{name}"))
    g = run.groupBy(*group).agg(F.max("__n").alias("__n"), *cols)

    def value_of(name, p):
        at = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return g.select(*group, *[value_of(name, p).alias(name) for name, p in probs.items()])


def _order_bits(x: str) -> Column:
    """The leading ORDER_BITS bits of a double's place in the order of doubles
    (sign, exponent and first digits), as an integer with the same order."""
    a = F.abs(F.col(x))
    top = F.when(a < LEAST, F.lit(0)).otherwise(
        F.floor((F.log2(F.greatest(a, F.lit(LEAST))) + LOG_SHIFT) * PER_OCTAVE) + 1)
    return F.when(F.col(x) < 0, -top).otherwise(top).cast("bigint")


def _upto(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``counts`` (group, __x, __c) with the rows of the group up to and
    including each value (__upto) and in all (__n), in one lazy plan.

    Values fall into buckets that keep their order. A group's bucket totals
    are few (at most 2 * 2100 * PER_OCTAVE) and run in one window; inside a
    bucket, distinct values run in one of its own."""
    b = counts.withColumn("__b", _order_bits("__x"))
    totals = b.groupBy(*group, "__b").agg(F.sum("__c").alias("__t"))
    order = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, "__b", F.coalesce(F.sum("__t").over(order), F.lit(0)).alias("__before"),
                           F.sum("__t").over(W.partitionBy(*group)).alias("__n"))
    inside = W.partitionBy(*group, "__b").orderBy("__x").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = b.withColumn("__r", F.sum("__c").over(inside)).alias("v")
    same = F.col("v.__b") == F.col("t.__b")
    for g in group:
        same = same & F.col(f"v.{g}").eqNullSafe(F.col(f"t.{g}"))
    return run.join(totals.alias("t"), same).select(
        *[F.col(f"v.{g}").alias(g) for g in group], "__x", "__c", "__n", (F.col("__r") + F.col("__before")).alias("__upto"))


def join_groups(df: DataFrame, per_group: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach a table of one row per group (null groups match). The table is
    bounded by the number of groups and is broadcast."""
    group = list(group)
    r = per_group.select(*[F.col(g).alias(f"__g_{g}") for g in group],
                         *[c for c in per_group.columns if c not in group])
    if not group:  # one row: scalar subqueries
        one = r.select(F.struct(*r.columns).alias("__o")).scalar()
        return df.select("*", *[one.getField(c).alias(c) for c in r.columns])
    on = None
    for g in group:
        e = F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        on = e if on is None else on & e
    return df.join(F.broadcast(r), on, how).drop(*[f"__g_{g}" for g in group])
