"""Cleaning and identifier audits of raw ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.functions.columns import composite_key
from raterlens.session import cut_lineage, spread


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur on more than one row (NULL keys group together).

    Counted with a partial aggregate, so a hot key costs one small row per map
    task instead of landing whole in one window partition."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    cond = None
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__k_{k}")
    for k in keys:
        c = left[k].eqNullSafe(r[f"__k_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    if how in ("left", "inner"):
        out = out.drop(*[f"__k_{k}" for k in keys])
    return out


def drop_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop *every* row whose key occurs more than once (pandas
    ``duplicated(keep=False)``); anti join, AQE splits skewed partitions.

    Keys hardly repeat, so they are counted in tasks of bounded size, and the
    repeated ones are written: if they are few, the planner sees it and the
    rows themselves are not shuffled."""
    twice = cut_lineage(repeated_keys(spread(df.select(*keys), *keys), keys).select(*keys))
    return _null_safe_join(df, twice, keys, "left_anti")


def rows_of_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return _null_safe_join(df, repeated_keys(df, keys).select(*keys), keys, "left_semi")


def dense_ids(values: DataFrame, key: str, id_col: str) -> DataFrame:
    """Dense 0-based id for each distinct ``key``, in ascending key order.

    Distributed zip-with-index: range-partition the distinct keys, number rows
    inside each partition, add the row count of all earlier partitions. The
    per-partition count table has one row per partition (bounded by the
    partition count, so broadcasting it is safe). Nothing passes the driver.
    """
    spark = values.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (values.select(key).filter(F.col(key).isNotNull()).distinct()
         .repartitionByRange(n_parts, key).sortWithinPartitions(key))
    from raterlens.session import cut_lineage

    # Fix partition membership once so row numbers and offsets agree even if
    # a stage is recomputed after an executor loss.
    d = cut_lineage(d.withColumn("__pid", F.spark_partition_id()))
    from pyspark.sql import Window as W

    numbered = d.withColumn("__rn", F.row_number().over(W.partitionBy("__pid").orderBy(key)))
    sizes = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn(
        "__off", F.coalesce(F.sum("__n").over(W.orderBy("__pid").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)))
    out = numbered.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
    return out.select(key, (F.col("__off") + F.col("__rn") - 1).cast("bigint").alias(id_col))


def text_digest(text: str):
    """128-bit digest of a text (null: null), the key that texts are joined by."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def text_ids(raw: DataFrame, text: str, id_col: str) -> DataFrame:
    """(__d, ``id_col``): dense ids of the distinct texts in ascending order of
    the text, by the text's digest. Each distinct text goes through the
    exchange once, for its order; rows only carry digests. Two texts with one
    digest would fail the job."""
    distinct = raw.select(text).filter(F.col(text).isNotNull()).distinct().withColumn("__d", text_digest(text))
    ids = dense_ids(distinct, text, id_col).withColumn("__d", text_digest(text)).drop(text)
    once = ids.groupBy("__d").agg(F.min(id_col).alias(id_col), F.max(id_col).alias("__other"))
    one = F.assert_true(F.col(id_col) == F.col("__other"), F.lit("two texts share a digest"))
    return once.filter(one.isNull()).select("__d", id_col)


def assign_text_ids(raw: DataFrame, text: str = "comment", id_col: str = "text_id") -> DataFrame:
    """Attach a dense text id per distinct comment; NULL comments match NULL
    (pandas merge semantics) and get a NULL id."""
    return raw.withColumn("__d", text_digest(text)).join(text_ids(raw, text, id_col), "__d", "left").select(
        *raw.columns, id_col)


def with_annotation_id(df: DataFrame, text_id: str = "text_id", rater: str = "worker_id") -> DataFrame:
    return df.withColumn("annotation_id", composite_key(text_id, rater))


def clean_ratings(raw: DataFrame, text: str = "comment", rater: str = "worker_id"):
    """Text ids, ``annotation_id = text_id_worker_id``, then drop every row
    of an annotation id seen more than once. Returns (kept, dropped).

    An annotation id repeats where its (comment, worker) does, and is NULL
    where either is; so repeats are found on the raw columns first and the ids
    are attached once, to the rows that are left."""
    raw = raw.drop("text_id")
    known = F.col(text).isNotNull() & F.col(rater).isNotNull()
    d = raw.withColumn("__d", text_digest(text)).withColumns(
        {"__c": F.when(known, F.col("__d")), "__w": F.when(known, F.col(rater))})
    again = repeated_keys(d, ["__c", "__w"]).select("__c", "__w")
    ids = text_ids(raw, text, "text_id")

    def keyed(how):
        rows = _null_safe_join(d, again, ["__c", "__w"], how).drop("__c", "__w")
        return with_annotation_id(rows.join(ids, "__d", "left").select(*raw.columns, "text_id"), "text_id", rater)

    return keyed("left_anti"), keyed("left_semi")


def conflicting_comment_ids(raw: DataFrame) -> DataFrame:
    """(comment_id, source) keys carrying more than one distinct comment."""
    return (raw.groupBy("comment_id", "source")
            .agg(F.countDistinct("comment").alias("n_comments"))
            .filter(F.col("n_comments") > 1))


def comments_multiple_source(raw: DataFrame) -> DataFrame:
    """Comment ids that occur with more than one source."""
    return (raw.groupBy("comment_id").agg(F.countDistinct("source").alias("n_sources"))
            .filter(F.col("n_sources") > 1))


def clean_by_conflict(raw: DataFrame, sample_key: str = "sample_id"):
    """J2 (older variant, kept for completeness):
    1. drop every row whose (comment_id, source) carries more than one comment;
    2. drop every row whose sample id (comment_id_source_worker_id) is repeated.
    Returns (kept rows, distinct dropped sample ids)."""
    keyed = raw.withColumn(sample_key, composite_key("comment_id", "source", "worker_id"))
    conflict_keys = conflicting_comment_ids(keyed).select("comment_id", "source")
    step1 = _null_safe_join(keyed, conflict_keys, ["comment_id", "source"], "left_semi").select(sample_key)
    rest = _null_safe_join(keyed, step1.distinct(), [sample_key], "left_anti")
    step3 = repeated_keys(rest, [sample_key]).select(sample_key)
    kept = _null_safe_join(rest, step3, [sample_key], "left_anti")
    dropped = step1.union(step3).distinct()
    return kept, dropped


def null_audit(df: DataFrame, columns=None) -> DataFrame:
    """Per column, the number of missing values (NULL, or NaN for
    floating columns) and whether there is any. One aggregate pass, then a
    built-in unpivot to one row per column."""
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    counts = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        miss = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        counts.append(F.count_if(miss).cast("bigint").alias(f.name))
    wide = df.agg(*counts)
    long = wide.unpivot([], [f.name for f in fields], "column_name", "n_missing")
    return long.withColumn("has_missing", F.col("n_missing") > 0)
