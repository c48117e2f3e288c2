"""Column helpers: NaN handling, keys, maps, argmax, rounding."""

from pyspark.sql import functions as F

from raterlens.functions.columns import argmax, binarize, composite_key, map_values, pct


def test_binarize_missing_and_nan_are_zero(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(binarize("s", 2)).collect()] == [1, 0, 0, 0]


def test_composite_key_null_part_gives_null(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "i long, w string")
    assert [r[0] for r in df.select(composite_key("i", "w")).collect()] == ["1_a", None]


def test_unmapped_value_is_null(spark):
    df = spark.createDataFrame([("yes",), ("1",), ("no",), ("maybe",)], "c string")
    got = [r[0] for r in df.select(map_values("c", {"1": 1, "yes": 1, "no": 0})).collect()]
    assert got == [1, 1, 0, None]


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.9],), ([2.0, -1.0, 2.0],)], "a array<double>")
    assert [r[0] for r in df.select(argmax("a")).collect()] == [0, 1, 0]


def test_percentage_rounds_half_even(spark):
    # 1/800 = 0.125 % -> 0.12 (Python round), not 0.13.
    df = spark.createDataFrame([(1, 800)], "n long, d long")
    assert df.select(pct("n", "d")).first()[0] == 0.12
    assert df.select(F.round(F.lit(0.125), 2)).first()[0] == 0.13
