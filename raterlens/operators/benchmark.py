"""External benchmark: positional attach of unkeyed predictions, label maps,
assembly of the (annotator x case) fact, sweep, welfare and sampled
trajectories (C8, B8, J28-J30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raterlens.config import BOUNDARY_CLASS_MAP, GOLD_LABEL_MAP, ORDER_RANGE, THRESHOLDS
from raterlens.functions.columns import map_values, nan_to_null, seeded_order, unique_on
from raterlens.operators.combine import threshold_sweep_metrics
from raterlens.operators.labels import first_n_per_group
from raterlens.operators.welfare import annotator_welfare


def with_ordinal(df: DataFrame, order_by: Sequence[str], col: str = "row_pos") -> DataFrame:
    """0-based row position of each row in ``order_by`` order (a unique key).

    Distributed zip-with-index: a range-partitioned sort fixes which rows each
    partition holds; rows are numbered inside their partition and shifted by
    the row count of all earlier partitions. The offsets table has one row per
    partition (bounded by the partition count, safe to broadcast). The
    partition assignment is written to the checkpoint folder so a recomputed stage after an
    executor loss numbers the same rows the same way."""
    from raterlens.session import cut_lineage

    order_by = list(order_by)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.repartitionByRange(n_parts, *order_by).sortWithinPartitions(*order_by)
                    .withColumn("__pid", F.spark_partition_id()))
    numbered = d.withColumn("__rn", F.row_number().over(W.partitionBy("__pid").orderBy(*order_by)))
    sizes = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(
        W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (numbered.join(F.broadcast(offsets), "__pid")
            .withColumn(col, (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
            .drop("__pid", "__rn", "__off"))


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str],
                    right_order: Sequence[str], drop_right_order: bool = True) -> DataFrame:
    """Glue two frames row by row (pandas ``concat(axis=1)``): explicit
    positions on both sides, then an equi-join on them. Unequal row counts
    fail the job (checked lazily inside the plan, no driver round trip)."""
    lp = with_ordinal(left, left_order, "__pos")
    rp = with_ordinal(right, right_order, "__pos")
    if drop_right_order:
        rp = rp.drop(*[c for c in right_order if c not in ("__pos",)])
    n_left = left.agg(F.count(F.lit(1))).scalar()
    n_right = right.agg(F.count(F.lit(1))).scalar()
    checked = F.coalesce(F.assert_true(n_left == n_right, F.lit("positional join: row counts differ")).cast("bigint"),
                         F.col("__pos"))
    return lp.withColumn("__pos", checked).join(rp, "__pos").drop("__pos")


def benchmark_cases(cases: DataFrame) -> DataFrame:
    """Gold label 'hateful'/'non-hateful' -> 1/0 (anything else NULL)."""
    return cases.select("case_id", map_values("label_gold", GOLD_LABEL_MAP).alias("label_gold"))


def boundary_predictions(raw: DataFrame) -> DataFrame:
    """Boundary class label '1'/'yes' -> 1, 'no' -> 0, else NULL; NaN
    confidence -> NULL."""
    return raw.select(*[c for c in raw.columns if c not in ("class_label", "confidence_score")],
                      map_values("class_label", BOUNDARY_CLASS_MAP).alias("boundary"),
                      nan_to_null("confidence_score").alias("confidence_score"))


def assemble_benchmark(catalog: DataFrame, cases: DataFrame, boundary_raw: DataFrame,
                       profile: DataFrame, case_order: str = "case_id",
                       boundary_order: str = "case_id") -> DataFrame:
    """Cases with mapped gold labels, boundary predictions attached by
    position (mapped), the prediction catalog (annotator x case) left-joined
    to them on ``case_id``, the extreme flag left-joined by annotator.

    The numbered case table is written once, so the planner sees its size and
    picks the join strategy. Repeated cases or annotators on the right sides
    are an error: they would multiply catalog rows."""
    from raterlens.session import cut_lineage

    c = cut_lineage(positional_join(benchmark_cases(cases), boundary_predictions(boundary_raw),
                                    [case_order], [boundary_order]))
    c = unique_on(c, "case_id")
    a = unique_on(profile.select("annotator_id", "extreme_annotator"), "annotator_id")
    return (catalog.join(c, "case_id", "left").join(a, "annotator_id", "left")
            .select("annotator_id", "case_id", "personalised", "label_gold", "boundary",
                    "confidence_score", "extreme_annotator"))


def benchmark_sweep(fact: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Threshold sweep against the gold label, undefined P/R = 0."""
    return threshold_sweep_metrics(fact, thresholds, truth="label_gold", zero_division="zero")


def benchmark_welfare(fact: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Per annotator and threshold welfare against the gold label."""
    return annotator_welfare(fact, thresholds, truth="label_gold", zero_division="zero")


def sample_trajectories(welfare: DataFrame, n_per_group: int = 5, seed: int = 0) -> DataFrame:
    """``n_per_group`` annotators drawn without replacement (seeded) from
    each extreme flag, with their macro-F1 at every threshold."""
    ann = welfare.select("annotator_id", "extreme_annotator").distinct().filter(
        F.col("extreme_annotator").isNotNull())
    ann = ann.withColumn("__ord", seeded_order("annotator_id", seed)).withColumn("__n", F.lit(n_per_group))
    picked = first_n_per_group(ann, "extreme_annotator", "__ord", "annotator_id", "__n", ORDER_RANGE)
    return welfare.join(picked.select("annotator_id"), "annotator_id", "left_semi").select(
        "extreme_annotator", "annotator_id", "confidence_threshold", "macro_f1")
