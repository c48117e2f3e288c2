"""Student-t tail probability as a column expression: the regularised
incomplete beta function by its continued fraction, folded inside the
expression. For aggregated tables (one row per threshold and group)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CF_STEPS = 300   # pairs of terms of the continued fraction
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, taken back by the
    recurrence (error below 1e-12)."""
    z = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    r = 1 / (z * z)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r / 1188)))) / z
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)


def _apart(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of I_x(a, b), evaluated forwards (c and d are the
    ratios of successive numerators and denominators)."""
    def step(s, coefficient):
        d = 1 / _apart(1 + coefficient * s["d"])
        c = _apart(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def pair(s, m):
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return step(step(s, even), odd)

    d = 1 / _apart(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CF_STEPS)), start, pair, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a)
            .otherwise(1 - front * _fraction(b, a, 1 - x) / b))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; NaN where t or dof is missing or dof
    isn't positive."""
    bad = t.isNull() | dof.isNull() | F.isnan(t) | F.isnan(dof) | (dof <= 0)
    return F.when(bad, F.lit(float("nan"))).otherwise(incomplete_beta(dof / 2, F.lit(0.5), dof / (dof + t * t)))
