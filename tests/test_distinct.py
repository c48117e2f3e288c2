"""Distinct counts by bitmaps, quantiles without a written table and text
keys by digest against plain computations."""

import random

import numpy as np
from pyspark.sql import functions as F

from raterlens.operators import clean, distinct, labels
from raterlens.operators.running import quantiles


def test_distinct_counts(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(-5, 70_000, 7)]), r.choice([None, 1 << 40, 3]), r.choice("abc ")) for _ in range(5_000)]
    d = spark.createDataFrame(rows, "a long, b long, c string")
    got = distinct.distinct_counts(d, ["a", "b", "c"]).first()
    assert tuple(got) == tuple(len({x[i] for x in rows if x[i] is not None}) for i in range(3))
    assert "Expand" not in distinct.distinct_counts(d, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert tuple(distinct.distinct_counts(d.limit(0), ["a", "c"]).first()) == (0, 0)


def test_quantiles_of_all_kinds_of_numbers(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 1e-320, -1e-320, 1e300, -1e300, 0.5, 0.5000000001, -3.0, *(r.gauss(0, 1) for _ in range(300)),
              *(round(r.random(), 2) for _ in range(500))]
    rows = [(g, v) for g in ("x", None) for v in values] + [("x", None), ("one", 7.5)]
    d = spark.createDataFrame(rows, "g string, v double")
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "h": 0.9, "hi": 1.0}
    got = {r.g: r for r in quantiles(d, ["g"], "v", probs).collect()}
    for g in ("x", None):
        assert np.allclose([got[g][n] for n in probs], np.quantile(values, list(probs.values())), rtol=1e-12)
    assert got["one"]["m"] == 7.5 and len(got) == 3


def test_text_ids_by_digest(spark):
    texts = ["b", "a", None, "", "b", "ü", "a" * 100_000]
    raw = spark.createDataFrame([(t, f"w{i}") for i, t in enumerate(texts)], "comment string, worker_id string")
    got = {(r.worker_id, r.text_id) for r in clean.assign_text_ids(raw).collect()}
    order = sorted({t for t in texts if t is not None}, key=lambda t: t.encode())
    assert got == {(f"w{i}", None if t is None else order.index(t)) for i, t in enumerate(texts)}
    kept, dropped = clean.clean_ratings(raw.union(raw.limit(2)))
    assert kept.count() == len(texts) - 2 and dropped.count() == 4


def test_majority_ties_and_missing_labels(spark):
    rows = [(1, "t", x) for x in (3, 3, 5, 5, 1)] + [(2, "u", None), (2, "u", None), (2, "u", 4)] + [(3, "v", -2)]
    d = spark.createDataFrame(rows, "text_id long, comment string, toxic_score int")
    low = {r.text_id: (r.text, r.label) for r in labels.majority_vote(d).collect()}
    high = {r.text_id: r.label for r in labels.majority_vote(d, tie_break="max").collect()}
    assert low == {1: ("t", 3), 2: ("u", None), 3: ("v", -2)} and high == {1: 5, 2: None, 3: -2}
    plan = labels._most_frequent(d, ["text_id"], "toxic_score", "min")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
