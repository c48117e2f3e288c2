"""Combined prediction and sweep semantics."""

from pyspark.sql import functions as F

from raterlens.operators.combine import combined_prediction, override_fraction, threshold_sweep_metrics

SCHEMA = "p int, b int, c double"


def combine(spark, rows, t, mode="asymmetric"):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r[0] for r in df.select(combined_prediction("p", "b", "c", t, mode)).collect()]


def test_threshold_edge_is_inclusive(spark):
    # t = 100 still overrides at confidence exactly 100 (>=).
    assert combine(spark, [(0, 1, 100.0)], 100) == [1]
    assert combine(spark, [(0, 1, 99.9)], 100) == [0]


def test_boundary_only_turns_zero_into_one(spark):
    assert combine(spark, [(1, 0, 100.0)], 70) == [1]
    assert combine(spark, [(0, 1, 80.0)], 70) == [1]


def test_null_and_nan_confidence_keep_personalised(spark):
    assert combine(spark, [(0, 1, None), (0, 1, float("nan")), (0, None, 99.0)], 70) == [0, 0, 0]


def test_symmetric_mode_is_strict_and_two_way(spark):
    assert combine(spark, [(1, 0, 80.0), (1, 0, 70.0)], 70, "symmetric") == [0, 1]


def test_override_fraction_non_increasing(spark):
    rows = [(i % 3 % 2, i % 2, (i // 2) % 2, 60.0 + i) for i in range(45)]
    df = spark.createDataFrame(rows, "y int, personalised int, boundary int, confidence_score double")
    out = override_fraction(df).orderBy("confidence_threshold").collect()
    fr = [r["overridden_preds_frac"] for r in out]
    assert fr == sorted(fr, reverse=True)
    assert [r["confidence_threshold"] for r in out] == [70, 75, 80, 85, 90, 95, 100]


def test_sweep_groups_and_combined_dominates(spark):
    rows = [(1, 0, 1, 90.0, True), (0, 0, 1, 95.0, False), (1, 1, 0, 99.0, None), (0, 1, 1, 50.0, False)]
    df = spark.createDataFrame(rows, "y int, personalised int, boundary int, confidence_score double, "
                                     "extreme_annotator boolean")
    out = threshold_sweep_metrics(df)
    groups = {r["annotator_group"]: r for r in out.filter(F.col("confidence_threshold") == 70).collect()}
    # A NULL flag counts in 'all' only.
    assert groups["all"]["support"] == 4
    assert groups["extreme"]["support"] == 1 and groups["non_extreme"]["support"] == 2
