"""Student-t tail against tabulated critical values, and the cells of the
bootstrap."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from raterlens.functions.stats import t_pvalue
from raterlens.operators import stats as st


def tail(spark, t, dof):
    d = spark.createDataFrame([(t, dof)], "t double, dof double")
    return d.select(t_pvalue(F.col("t"), F.col("dof"))).first()[0]


@pytest.mark.parametrize("t,df,p", [
    (12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (1.96, 1e6, 0.05),
    (2.576, 1e6, 0.01), (3.169, 10, 0.01), (0.0, 5, 1.0), (-3.169, 10, 0.01),
])
def test_two_sided_p(spark, t, df, p):
    assert tail(spark, t, float(df)) == pytest.approx(p, abs=5e-4)


def test_two_sided_p_in_closed_form(spark):
    for t in (0.01, 0.7, 3.0, 50.0):
        assert tail(spark, t, 1.0) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-11)
        assert tail(spark, t, 2.0) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-11)


def test_invalid_inputs_give_nan(spark):
    assert math.isnan(tail(spark, float("nan"), 3.0))
    assert math.isnan(tail(spark, 1.0, 0.0))
    assert math.isnan(tail(spark, None, 3.0))


def test_poisson_table_is_the_distribution():
    rows = st.poisson_table()
    for mean in (1, 7, 15):
        mine = [r for r in rows if r[0] == mean]
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert sum(r[1] * (min(r[3], 1.0) - r[2]) for r in mine) == pytest.approx(mean, abs=1e-9)


def test_bootstrap_of_cells_has_the_spread_of_the_mean(spark):
    """Against the normal interval, with cells of few and of many rows, a null
    group and missing values."""
    values = [0.1] * 400 + [0.5] * 30 + [i / 97 for i in range(97)]
    rows = [(g, v) for g in ("a", None) for v in values] + [("a", None), ("one", 0.25)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in st.mean_with_ci(d, ["g"], "v", replicates=400, seed=5).collect()}
    n, mean = len(values), sum(values) / len(values)
    half = 1.96 * math.sqrt(sum((v - mean) ** 2 for v in values) / n / n)
    for g in ("a", None):
        assert (got[g].n, got[g].mean) == (n, pytest.approx(mean))
        assert got[g].ci_low == pytest.approx(mean - half, abs=0.2 * half)
        assert got[g].ci_high == pytest.approx(mean + half, abs=0.2 * half)
    assert (got["one"].n, got["one"].ci_low, got["one"].ci_high) == (1, 0.25, 0.25)
    assert Counter(r.g for r in st.mean_with_ci(d, ["g"], "v", 400, 5).collect()) == Counter(got.keys())
    (whole,) = st.mean_with_ci(d, [], "v", replicates=40).collect()
    assert whole.n == 2 * n + 1


def test_bootstrap_of_rows_draws_by_key(spark):
    """Every row's weight comes from its key, also where values are equal
    (cells drew once for all of them); against a plain computation, with
    repeated keys and a null group."""
    import hashlib

    import numpy as np

    reps, seed = 30, 3
    rows = [(g, k % 40, [0.25, 0.5, 1.0][k % 3]) for g in ("a", None) for k in range(60)] + [("a", 7, None)]
    d = spark.createDataFrame(rows, "g string, k long, v double").repartition(3)
    got = {r.g: r for r in st.mean_with_ci(d, ["g"], "v", replicates=reps, seed=seed, key="k").collect()}

    def weight(k, s):
        order = int(hashlib.sha256(f"{k}_{s // 4}".encode()).hexdigest()[16 * (s % 4):][:13], 16)
        return sum(order / 16 ** 13 >= c for c in st.POISSON1_CDF)

    for g in ("a", None):
        mine = [(k, v) for h, k, v in rows if h == g and v is not None]
        means = []
        for s in range(seed * reps, seed * reps + reps):
            w = [weight(k, s) for k, _ in mine]
            means.append(sum(a * v for a, (_, v) in zip(w, mine)) / sum(w))
        assert (got[g].n, got[g].mean) == (60, pytest.approx(sum(v for _, v in mine) / 60))
        assert (got[g].ci_low, got[g].ci_high) == tuple(pytest.approx(q) for q in np.quantile(means, [0.025, 0.975]))
    (whole,) = st.mean_with_ci(d, [], "v", replicates=10, key="k").collect()
    assert whole.n == 120


def test_bootstrap_of_rows_takes_a_digest_for_every_weight(spark):
    """The query draws each of its 200 weights from a digest of its own (four
    shared one); against a plain computation, with a null key, repeated keys
    and groups cut over tasks."""
    import hashlib

    import numpy as np

    from raterlens.plans import all_oracles

    reps, seed = 30, 3
    rows = [(g, k % 40, [0.25, 0.5, 1.0][k % 3]) for g in ("a", None) for k in range(60)]
    rows += [("a", None, 0.75), ("a", 7, None)]
    d = spark.createDataFrame(rows, "g string, k long, v double").repartition(3)
    got = {r.g: r for r in st.mean_with_ci(d, ["g"], "v", replicates=reps, seed=seed, key="k", own_digests=True).collect()}

    def weight(k, s):
        order = 16 ** 13 if k is None else int(hashlib.md5(f"{k}_{s}".encode()).hexdigest()[:13], 16)
        return sum(order / 16 ** 13 >= c for c in st.POISSON1_CDF)

    for g, n in (("a", 61), (None, 60)):
        mine = [(k, v) for h, k, v in rows if h == g and v is not None]
        means = []
        for s in range(seed * reps, seed * reps + reps):
            w = [weight(k, s) for k, _ in mine]
            means.append(sum(a * v for a, (_, v) in zip(w, mine)) / sum(w))
        assert (got[g].n, got[g].mean) == (n, pytest.approx(sum(v for _, v in mine) / n))
        assert (got[g].ci_low, got[g].ci_high) == tuple(pytest.approx(q) for q in np.quantile(means, [0.025, 0.975]))
    sql = all_oracles()["mean_with_ci"]
    assert "cast((600 + rep) as varchar)" in sql and "(600 + rep)) // 4" not in sql and "range(200)" in sql
