"""Metric definition edge cases (classification report, binary F1)."""

import pytest

from raterlens.operators.metrics import binary_f1, classification_report


def report(spark, rows, zero="zero", keys=()):
    df = spark.createDataFrame(rows, "g string, y int, p int")
    out = classification_report(df, list(keys) or ["g"], "y", "p", zero_division=zero)
    return {r["g"]: r.asDict() for r in out.collect()}


def test_one_class_predicted_perfectly_has_macro_f1_one(spark):
    r = report(spark, [("a", 1, 1), ("a", 1, 1)])["a"]
    assert r["f1_score"] == 1.0 and r["accuracy"] == 1.0 and r["n_labels"] == 1


def test_class_only_predicted_counts_in_label_set(spark):
    # y = {0}, yhat has a 1: labels {0, 1}; label 1 has precision 0, recall undefined.
    r = report(spark, [("a", 0, 0), ("a", 0, 1)])["a"]
    assert r["n_labels"] == 2
    assert r["f1_score"] == pytest.approx((2 * 1 / 3 + 0.0) / 2)
    assert r["recall"] == pytest.approx((0.5 + 0.0) / 2)  # undefined recall -> 0


def test_zero_division_null_skips_undefined(spark):
    r = report(spark, [("a", 0, 0), ("a", 0, 1)], zero="null")["a"]
    assert r["recall"] == pytest.approx(0.5)  # label 1 left out of the mean
    assert r["f1_score"] == pytest.approx((2 * 1 / 3 + 0.0) / 2)  # macro-F1 unchanged


def test_groups_have_their_own_label_sets(spark):
    rows = [("a", 1, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1), ("b", 0, 0)]
    r = report(spark, rows)
    assert r["a"]["n_labels"] == 1 and r["b"]["n_labels"] == 2
    # b: label 0: tp1 true2 pred1 -> f1 2/3 ; label 1: tp1 true1 pred2 -> f1 2/3
    assert r["b"]["f1_score"] == pytest.approx(2 / 3)
    assert r["b"]["support"] == 3


def test_weights_equal_repeated_rows(spark):
    plain = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "y int, p int")
    weighted = spark.createDataFrame([(1, 1, 2), (0, 1, 1), (0, 0, 1)], "y int, p int, n long")
    a = classification_report(plain, [], "y", "p").first()
    b = classification_report(weighted, [], "y", "p", weight="n").first()
    for c in ("accuracy", "precision", "recall", "f1_score", "support"):
        assert a[c] == pytest.approx(b[c])


def test_binary_f1_zero_when_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    assert binary_f1(df, [], "y", "p").first()["f1"] == 0.0
