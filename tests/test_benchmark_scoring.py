"""Positional join, key guards, head scoring and head fitting."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raterlens.operators import benchmark as bm
from raterlens.operators import combine
from raterlens.operators import scoring as sc


def test_positional_join_glues_rows_in_order(spark):
    left = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(20, "y"), (10, "x"), (30, "z")], "o long, w string")
    out = bm.positional_join(left, right, ["k"], ["o"]).orderBy("k").collect()
    assert [(r["k"], r["v"], r["w"]) for r in out] == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]


def test_positional_join_rejects_unequal_counts(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1,)], "o long")
    with pytest.raises(Exception):
        bm.positional_join(left, right, ["k"], ["o"]).collect()


def test_attach_logits_rejects_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 1)], "text_id long, annotator_id long")
    lg = spark.createDataFrame([(1, 1, [0.0, 1.0]), (1, 1, [1.0, 0.0])],
                               "text_id long, annotator_id long, logits array<double>")
    with pytest.raises(Exception):
        sc.attach_logits(rows, lg).collect()


def test_head_scoring_uses_each_rows_head(spark):
    feats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "annotator_id long, embedding array<float>")
    heads = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.5]),
                                   (2, [[0.0, 0.0], [1.0, 1.0]], [1.0, 0.0])],
                                  "annotator_id long, weights array<array<double>>, bias array<double>")
    out = {r["annotator_id"]: r["logits"] for r in sc.score_with_heads(feats, heads).collect()}
    assert out[1] == [1.0, 2.5] and out[2] == [1.0, 3.0]


def test_cross_entropy_of_uniform_logits_is_log2(spark):
    import math

    df = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 0.0], 0)], "logits array<double>, label int")
    r = sc.weighted_cross_entropy(df).first()
    assert r["loss_mean"] == pytest.approx(math.log(2))


def _head_rows():
    rows = []
    for a in (1, 2):
        for i in range(30):
            x = (i % 10) / 10.0 + (0.0 if i % 2 else 1.0)
            y = 0 if i % 2 else 1
            if a == 2:
                y = 1 - y
            rows.append((a, [x, 1.0 - x], y))
    return rows


def test_fitted_heads_separate_separable_data(spark):
    df = spark.createDataFrame(_head_rows(), "annotator_id long, embedding array<double>, y int")
    heads = sc.fit_annotator_heads(df, dim=2, l2=0.01)
    scored = sc.score_with_heads(df, heads.select("annotator_id", "weights", "bias")).withColumn(
        "pred", sc.predicted_label("logits"))
    acc = scored.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9


def test_split_annotators_get_the_same_heads(spark):
    """Whole groups, parts of seven rows, and a closed small case (the
    penalised optimum has a zero gradient) agree."""
    df = spark.createDataFrame(_head_rows(), "annotator_id long, embedding array<double>, y int")
    whole = {r["annotator_id"]: r for r in sc.fit_annotator_heads(df, dim=2).collect()}
    parts = {r["annotator_id"]: r for r in sc.fit_annotator_heads(df, dim=2, group_rows=7).collect()}
    assert all(r["converged"] and r["n_rows"] == 30 for r in [*whole.values(), *parts.values()])
    for a in (1, 2):
        w = np.array([*whole[a]["weights"][1], whole[a]["bias"][1]]) * 2
        v = np.array([*parts[a]["weights"][1], parts[a]["bias"][1]]) * 2
        assert np.allclose(w, v, atol=1e-6)
        x = np.array([[*e, 1.0] for i, e, _ in _head_rows() if i == a])
        y = np.array([y for i, _, y in _head_rows() if i == a])
        assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - w).max() < 1e-6


def test_repeated_keys_on_a_right_side_fail(spark):
    catalog = spark.createDataFrame([(1, 5, 1)], "annotator_id long, case_id long, personalised int")
    cases = spark.createDataFrame([(5, "hateful")], "case_id long, label_gold string")
    boundary = spark.createDataFrame([(5, "1", 90.0)], "case_id long, class_label string, confidence_score double")
    twice = spark.createDataFrame([(1, True), (1, False)], "annotator_id long, extreme_annotator boolean")
    assert bm.assemble_benchmark(catalog, cases, boundary, twice.limit(1)).count() == 1
    with pytest.raises(Exception, match="repeated key"):
        bm.assemble_benchmark(catalog, cases, boundary, twice).collect()
    rows = spark.createDataFrame([(1, 1, 0, 0)], "text_id long, annotator_id long, y int, personalised int")
    preds = spark.createDataFrame([(1, 1, 80.0), (1, 0, 70.0)], "text_id long, prediction int, confidence_score double")
    with pytest.raises(Exception, match="repeated key"):
        combine.assemble_eval_fact(rows, preds, twice.limit(1)).collect()


def _rated_vectors(spark, n_annotators=3):
    rows = [(a, t, t % 4, (a * t) % 2) for a in range(n_annotators) for t in range(8 + a)]
    vectors = [(v, [float(v), 1.0 - v]) for v in range(4)]
    return (spark.createDataFrame(rows, "annotator_id long, text_id long, vec_id long, y int"),
            spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))


def test_heads_are_not_broadcast(spark):
    """However small the planner thinks the array columns: a broadcast of a
    large head table ends the job."""
    rows, vectors = _rated_vectors(spark)
    heads = spark.range(3).select(F.col("id").alias("annotator_id"), F.expr(
        "array(array(1D, 0D), array(0D, cast(id as double)))").alias("weights"), F.expr("array(0D, 1D)").alias("bias"))
    scored = sc.score_with_heads(rows, heads, vectors=vectors)
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [annotator_id" in plan
    for r in scored.collect():
        x = r["vec_id"], 1.0 - r["vec_id"]
        assert r["logits"] == [x[0], 1.0 + r["annotator_id"] * x[1]]


def test_heads_fitted_by_key_equal_those_of_joined_rows(spark):
    rows, vectors = _rated_vectors(spark, 5)
    wide = {r["annotator_id"]: r for r in sc.fit_annotator_heads(rows.join(vectors, "vec_id"), dim=2).collect()}
    keyed = {r["annotator_id"]: r for r in sc.fit_annotator_heads(rows, dim=2, vectors=vectors).collect()}
    assert wide.keys() == keyed.keys() and len(keyed) == 5
    for a, r in keyed.items():
        assert r["converged"] and r["n_rows"] == 8 + a
        assert np.allclose(r["weights"], wide[a]["weights"], atol=1e-9)
        assert np.allclose(r["bias"], wide[a]["bias"], atol=1e-9)


def test_annotators_share_a_group(spark, monkeypatch):
    """A call of the fit for every annotator made the time; groups hold many."""
    rows, vectors = _rated_vectors(spark, 40)
    grouped = []
    real = sc._fit_group
    monkeypatch.setattr(sc, "_fit_group", lambda l2: grouped.append(l2) or real(l2))
    heads = sc.fit_annotator_heads(rows, dim=2, vectors=vectors).collect()
    assert grouped == [1.0] and len(heads) == 40
    table = pa.table({"annotator_id": [1, 2, 1], "x": [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]], "y": [1.0, 0.0, 0.0]})
    out = real(1.0)(table).to_pylist()
    assert sorted((r["annotator_id"], r["n_rows"], r["converged"]) for r in out) == [(1, 2, True), (2, 1, True)]


def _optimality_rows(spark):
    """Rows and vectors with repeated vector keys, keys without a vector, null
    keys, annotators and labels, and an annotator of many rows."""
    rows = [(a, t % 6, (a * t) % 2) for a in range(4) for t in range(9 + a)] + [(9, t % 4, t % 2) for t in range(60)]
    rows += [(2, None, 1), (None, 1, 0), (5, 5, 1), (3, 2, None), (6, 1, None), (7, 0, 1)]
    vectors = [(v, [float(v), 1.0 - v, 0.5]) for v in range(5)] + [(1, [0.25, 2.0, -1.0]), (None, [1.0, 1.0, 1.0])]
    heads = [(a, [[0.0] * 3, [0.1 * a, -0.2, 0.3]], [0.0, 0.05 * a], 60 if a == 9 else 9) for a in (0, 1, 2, 3, 5, 6, 8, 9)]
    return (spark.createDataFrame(rows, "annotator_id long, vec_id long, y int").repartition(3),
            spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
            spark.createDataFrame(heads, "annotator_id long, weights array<array<double>>, bias array<double>, n_rows long"))


@pytest.mark.parametrize("group_rows", [4096, 7])
def test_certificate_by_key_equals_that_of_joined_rows(spark, group_rows):
    rows, vectors, heads = _optimality_rows(spark)
    wide = {r["annotator_id"]: r for r in sc.head_optimality(rows.join(vectors, "vec_id"), heads, 3).collect()}
    keyed = sc.head_optimality(rows, heads, 3, vectors=vectors, group_rows=group_rows).collect()
    assert sorted(r["annotator_id"] for r in keyed) == sorted(wide) == [0, 1, 2, 3, 6, 9]
    for r in keyed:
        other = wide[r["annotator_id"]]
        assert r["n_rows"] == other["n_rows"]
        assert r["gradient"] == (None if other["gradient"] is None else pytest.approx(other["gradient"], rel=1e-9))
    assert wide[6]["gradient"] is None and wide[9]["n_rows"] == 75
    counted = sc.head_optimality(rows, heads.drop("n_rows"), 3, vectors=vectors, group_rows=group_rows).collect()
    assert sorted((r["annotator_id"], r["n_rows"]) for r in counted) == sorted((a, r["n_rows"]) for a, r in wide.items())




def test_heads_and_vectors_do_not_travel_with_the_rows(spark):
    """Every row carried its head (64 doubles) through the shuffle by vector,
    and every partial sum its head again: 24 GB of disk at 1 GB of input."""
    rows, vectors, heads = _optimality_rows(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = sc.head_optimality(rows.withColumn("vec_id", F.col("vec_id") + 0), heads, 3, vectors=vectors)
        plan = c._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "key" in joins[0]  # only the distinct keys of a deal meet the vectors
    assert "Aggregate [deal" in plan
    # a vector is moved once a deal, however many rows have it
    dealt = rows.dropna().select(F.lit(0).alias("deal"), F.col("vec_id").alias("x"))
    assert sc._vectors_of(dealt, vectors, "vec_id", "embedding").count() == 6
