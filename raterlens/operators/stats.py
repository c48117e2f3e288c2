"""Statistics over aggregated tables: Welch test, histogram, box plot,
bootstrap interval (D25-D28)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlens.config import ORDER_DIGITS, ORDER_KEYS, ORDER_RANGE
from raterlens.functions.columns import order_digest, order_key, seeded_order
from raterlens.functions.stats import t_pvalue
from raterlens.operators.running import join_groups, quantiles
from raterlens.session import cut_lineage

# Poisson(1) cumulative probabilities P(K <= k) for the bootstrap weights, up to
# the resolution of a double (P(K > 17) is below 1e-16).
POISSON1_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(k + 1)) for k in range(18)]
GROUPS_HELD = 1000   # sums of so many groups are held by a task before they are passed on
POISSON_EXACT = 16   # means below it are drawn by the inverse distribution
RESOLUTION = 1e-9    # values nearer than this are one cell of the bootstrap


def welch_ttest(df: DataFrame, group: Sequence[str], sample_col: str, value: str, reference) -> DataFrame:
    """Welch's t statistic and Welch-Satterthwaite degrees of freedom of
    sample ``reference`` against every other sample, per ``group``. Moments
    come from one aggregate; the reference row is joined back (a small table:
    one row per group and sample)."""
    group = list(group)
    mom = df.groupBy(*group, sample_col).agg(
        F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    a = mom.filter(F.col(sample_col) == F.lit(reference)).select(
        *group, F.col("m").alias("m_a"), F.col("v").alias("v_a"), F.col("n").alias("n_a"))
    b = mom.filter(F.col(sample_col) != F.lit(reference)).select(
        *group, F.col(sample_col).alias("threshold_b"), F.col("m").alias("m_b"), F.col("v").alias("v_b"),
        F.col("n").alias("n_b"))
    j = a.join(b, group) if group else a.join(b, how="inner")
    se_a = F.col("v_a") / F.col("n_a")
    se_b = F.col("v_b") / F.col("n_b")
    se = se_a + se_b
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(se))
    dof = F.try_divide(se * se, se_a * se_a / (F.col("n_a") - 1) + se_b * se_b / (F.col("n_b") - 1))
    return j.select(*group, F.lit(reference).alias("threshold_a"), "threshold_b",
                    t.alias("t_stat"), dof.alias("dof"), "n_a", "n_b")


def with_welch_pvalue(tests: DataFrame) -> DataFrame:
    return tests.withColumn("pvalue", t_pvalue(F.col("t_stat"), F.col("dof")))


def histogram_density(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), count and
    density = count / (n * width). Bounds come from a scalar subquery."""
    st = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    lo = st.select("lo").scalar()
    hi = st.select("hi").scalar()
    n = st.select("n").scalar()
    width = (hi - lo) / F.lit(float(bins))
    x = F.col(value).cast("double")
    b = F.least(F.coalesce(F.floor(F.try_divide(x - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    g = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_in_bin"))
    return g.select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_end"), "n_in_bin",
                    F.try_divide(F.col("n_in_bin"), n * width).alias("density"))


def boxplot_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles (linear interpolation), IQR, whiskers at the most
    extreme values within 1.5 IQR, outlier count, per group."""
    group = list(group)
    df = cut_lineage(df.select(*group, value))  # read for the quartiles and for the whiskers
    q = quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = join_groups(df, q, group)
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - 1.5 * iqr
    hi_f = F.col("q3") + 1.5 * iqr
    x = F.col(value)
    return j.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("n_outliers"),
        F.count(x).alias("n")).withColumn("iqr", F.col("q3") - F.col("q1"))


def poisson_table(below: int = POISSON_EXACT) -> list[tuple]:
    """Rows (mean, draw, low, high) for the means 1 to ``below`` - 1: the draw
    is given by uniforms in [low, high), and the last one by all above."""
    rows = []
    for mean in range(1, below):
        p, upto, k = math.exp(-mean), 0.0, 0
        while upto < 1.0 - 1e-15 and k < 8 * below:
            rows.append((mean, k, upto, upto + p))
            upto, k = upto + p, k + 1
            p *= mean / k
        rows[-1] = (*rows[-1][:3], 2.0)
    return rows


def _row_sums(n_group: int, replicates: int, first: int, own_digests: bool):
    """Sums of a task's rows by (group, replicate): weights (__n) and weighted
    values (__t); replicate -1 has weight 1. A key's weights come from its
    digests, taken once a batch."""
    a_digest = 1 if own_digests else ORDER_KEYS
    blocks = range(first // a_digest, (first + replicates - 1) // a_digest + 1)
    skip = first % a_digest
    ends = [f"_{b}".encode() for b in blocks]

    def weights(key: str) -> bytes:
        k = key.encode()
        if own_digests:
            return b"".join([hashlib.md5(k + e).digest()[:8] for e in ends])
        return b"".join([hashlib.sha256(k + e).digest() for e in ends])

    def rows(held: dict, schema: pa.Schema):
        groups = list(zip(*held)) if n_group else []
        columns = [pa.array(np.repeat(np.arange(len(held)), replicates + 1))]
        columns = [pa.array(c, f.type).take(columns[0]) for c, f in zip(groups, schema)]
        n, t = (np.concatenate([v[i] for v in held.values()]) for i in (0, 1))
        r = np.tile(np.arange(-1, replicates, dtype=np.int32), len(held))
        return pa.RecordBatch.from_arrays([*columns, pa.array(r), pa.array(n), pa.array(t)],
                                          names=[*schema.names[:n_group], "__r", "__n", "__t"])

    def run(batches):
        cdf, held = np.array(POISSON1_CDF), {}
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(n_group).dictionary_encode()
            digests = b"".join(map(weights, keys.dictionary.to_pylist()))
            order = np.frombuffer(digests, ">u8").reshape(-1, a_digest * len(blocks))[:, skip:skip + replicates]
            u = (order >> np.uint64(64 - 4 * ORDER_DIGITS)) / float(ORDER_RANGE)
            drawn = np.searchsorted(cdf, u, "right")
            drawn = np.vstack([drawn, np.full((1, replicates), len(cdf))])  # a null key, as SQL has it
            w = drawn[keys.indices.fill_null(len(keys.dictionary)).to_numpy()]
            w = np.hstack([np.ones((len(w), 1), np.int64), w])
            v = b.column(n_group + 1).to_numpy(zero_copy_only=False)
            number: dict = {}
            names = zip(*[b.column(i).to_pylist() for i in range(n_group)]) if n_group else [()] * len(v)
            at = np.array([number.setdefault(g, len(number)) for g in names])
            for g, i in number.items():
                mine = w[at == i]
                n, t = held.get(g, (0, 0.0))
                held[g] = n + mine.sum(axis=0), t + v[at == i] @ mine
            if len(held) > GROUPS_HELD:
                yield rows(held, b.schema)
                held = {}
        if held:
            yield rows(held, b.schema)

    return run


def _row_bootstrap(df: DataFrame, group: list, key: str, value: str, replicates: int, seed: int, level: float,
                   own_digests: bool) -> DataFrame:
    x = df.filter(F.col(value).isNotNull()).select(
        *group, F.col(key).cast("string").alias("__key"), F.col(value).cast("double").alias("__x"))
    schema = T.StructType([*x.schema[:len(group)], T.StructField("__r", T.IntegerType()),
                           T.StructField("__n", T.LongType()), T.StructField("__t", T.DoubleType())])
    each = _row_sums(len(group), replicates, seed * replicates, own_digests)
    sums = x.mapInArrow(each, schema).groupBy(*group, "__r").agg(F.sum("__n").alias("__n"), F.sum("__t").alias("__t"))
    m = F.try_divide("__t", "__n")
    every = F.col("__r") < 0
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    per = sums.groupBy(*group).agg(F.max(F.when(every, m)).alias("mean"), F.max(F.when(every, F.col("__n"))).alias("n"),
                                   F.percentile(F.when(~every, m), [lo, hi]).alias("__ci"))
    return per.select(*group, "mean", "n", F.col("__ci")[0].alias("ci_low"), F.col("__ci")[1].alias("ci_high"))


def mean_with_ci(df: DataFrame, group: Sequence[str], value: str, replicates: int = 200, seed: int = 0,
                 level: float = 0.95, resolution: float = RESOLUTION, key: str | None = None,
                 own_digests: bool = False) -> DataFrame:
    """Mean and bootstrap percentile interval per group, by a Poisson
    bootstrap.

    With ``key`` each row gets an independent Poisson(1) weight per replicate
    from the seeded hash of its key: from the keys of :func:`seeded_order`, of
    which ORDER_KEYS share a digest, or with ``own_digests`` from an MD5 digest
    of key and seed for every weight. Tasks sum the weights and the weighted
    values of their rows by group and replicate, so rows are neither
    multiplied nor resampled, and the intervals are taken over groups x
    replicates means.

    Without one, cells are drawn. Rows of one group with equal values are exchangeable: the Poisson(1)
    weights of n such rows sum to a Poisson(n) weight. So rows are counted by
    (group, value), values being equal to within ``resolution``, and each cell
    draws one weight a replicate, from the seeded hash of its group and value.
    Means below POISSON_EXACT are drawn by the inverse distribution (a small
    table, joined), larger ones by the normal quantile with its correction for
    skewness. Cells are multiplied by the replicates inside the tasks, where
    the sums by (group, replicate) begin; the intervals are taken over
    groups x replicates means."""
    group = list(group)
    if key is not None:
        return _row_bootstrap(df, group, key, value, replicates, seed, level, own_digests)
    spark = df.sparkSession
    step = F.round(F.col(value) / F.lit(resolution)).cast("bigint")
    cells = df.filter(F.col(value).isNotNull()).groupBy(*group, step.alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"), F.sum(value).alias("__s"))
    cells = cut_lineage(cells)
    name = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group], F.col("__v").cast("string"))
    first = ORDER_KEYS * math.ceil(2 * seed * replicates / ORDER_KEYS)  # a digest serves ORDER_KEYS replicates
    blocks = (cells.repartition(spark.sparkContext.defaultParallelism).select(
        *group, "__v", "__c", name.alias("__name"),
        F.explode(F.sequence(F.lit(0), F.lit(math.ceil(replicates / ORDER_KEYS) - 1))).alias("__b"))
        .withColumn("__d", order_digest("__name", F.lit(first // ORDER_KEYS) + F.col("__b"))))
    draws = blocks.select("*", F.posexplode(F.array(*[order_key("__d", i) for i in range(ORDER_KEYS)]))) \
        .withColumn("__r", F.col("__b") * ORDER_KEYS + F.col("pos")).filter(F.col("__r") < replicates)

    def uniform(order):
        return (order + F.lit(0.5)) / F.lit(float(ORDER_RANGE))

    u = uniform(F.conv("col", 16, 10).cast("bigint"))
    other = uniform(seeded_order("__name", F.lit(first + ORDER_KEYS * math.ceil(replicates / ORDER_KEYS)) + F.col("__r")))

    table = F.broadcast(spark.createDataFrame(poisson_table(), "__c bigint, __k int, __low double, __high double"))
    few = draws.filter(F.col("__c") < POISSON_EXACT).withColumn("__u", u).join(table, "__c").filter(
        (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high"))).select(*group, "__v", "__r", "__k")
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * other)
    c = F.col("__c")
    many = draws.filter(c >= POISSON_EXACT).withColumn("__z", z).select(
        *group, "__v", "__r", F.greatest(F.lit(0), F.floor(
            c + F.sqrt(c) * F.col("__z") + (F.col("__z") * F.col("__z") - 1) / 6 + 0.5)).cast("int").alias("__k"))
    sums = few.unionByName(many).groupBy(*group, "__r").agg(
        F.sum("__k").alias("__n"), F.sum(F.col("__k") * F.col("__v") * F.lit(resolution)).alias("__t"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    interval = sums.groupBy(*group).agg(F.percentile(F.try_divide("__t", "__n"), [lo, hi]).alias("__ci"))
    means = cells.groupBy(*group).agg((F.sum("__s") / F.sum("__c")).alias("mean"), F.sum("__c").alias("n"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"i.{c}")) for c in group]
    joined = means.alias("m").join(interval.alias("i"), same) if group else means.alias("m").join(interval.alias("i"))
    return joined.select(*[F.col(f"m.{c}").alias(c) for c in group], "mean", "n",
                         F.col("__ci")[0].alias("ci_low"), F.col("__ci")[1].alias("ci_high"))
