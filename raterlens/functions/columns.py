"""Column-expression helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlens.config import ORDER_DIGITS, ORDER_KEYS


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL, so that ``NaN >= t`` cannot become TRUE (Spark orders NaN
    above every number)."""
    c = col_(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def binarize(score, threshold) -> Column:
    """``score >= threshold`` as 0/1; missing or NaN score gives 0."""
    return F.coalesce((nan_to_null(score) >= F.lit(threshold)).cast("int"), F.lit(0))


def composite_key(*parts) -> Column:
    """``a_b_c`` string key; a NULL part makes the whole key NULL (unlike
    ``concat_ws``, which would skip it)."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit("_"))
        pieces.append(col_(p).cast("string"))
    return F.concat(*pieces)


def map_values(c, mapping: Mapping, value_type: str = "int") -> Column:
    """Dictionary mapping; unmapped values (and NULL) give NULL."""
    c = col_(c)
    out = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        out = F.when(cond, F.lit(v).cast(value_type)) if out is None else out.when(
            cond, F.lit(v).cast(value_type))
    return out


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array column (numpy argmax)."""
    a = col_(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def seeded_order(id_col, seed) -> Column:
    """Reproducible pseudo-random order key in [0, ORDER_RANGE) for an id, an
    order of its own for every seed (a number or a column, not negative). SQL
    engines compute the same value (``plans.sqlkit.seeded_order_sql``)."""
    s = (seed if isinstance(seed, Column) else F.lit(seed)).cast("bigint")
    block = F.floor(s / ORDER_KEYS).cast("bigint")
    return F.conv(order_key(order_digest(id_col, block), s), 16, 10).cast("bigint")


def order_digest(id_col, block) -> Column:
    """Digest that holds an id's order keys for the seeds of a block, which are
    ORDER_KEYS * block up to ORDER_KEYS * block + ORDER_KEYS - 1."""
    b = block if isinstance(block, Column) else F.lit(block)
    return F.sha2(F.concat(col_(id_col).cast("string"), F.lit("_"), b.cast("string")), 256)


def order_key(digest, seed) -> Column:
    """A seed's order key, as hex digits (their order is that of the numbers)."""
    place = 64 // ORDER_KEYS * (seed % ORDER_KEYS) + 1
    if isinstance(seed, Column):
        return col_(digest).substr(place.cast("int"), F.lit(ORDER_DIGITS))
    return col_(digest).substr(place, ORDER_DIGITS)


def log_sum_exp(arr) -> Column:
    """Numerically stable log(sum(exp(x))) of a double array."""
    a = col_(arr)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0).cast("double"),
                                 lambda acc, x: acc + F.exp(x - m)))


def dot(a, b) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def pct(num, den, digits: int = 2) -> Column:
    """Percentage rounded half-even (Python ``round``)."""
    return F.bround(F.lit(100.0) * col_(num) / col_(den), digits)


def r6(c) -> Column:
    """Round a double to 6 digits for stable output comparison."""
    return F.round(col_(c).cast("double"), 6)


def threshold_array(thresholds: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(t)) for t in thresholds])


def unique_on(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, failing the job (lazily) if a key occurs more than once; rows
    with a NULL key match nothing and are left out. One aggregate by the key,
    whose partitioning the following join on it reuses."""
    rest = [c for c in df.columns if c not in keys]
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest) if rest else F.lit(True)).alias("__r"))
    ok = F.coalesce(F.assert_true(F.col("__n") == 1, F.lit("repeated key " + ", ".join(keys))).cast("boolean"), F.lit(True))
    return g.filter(ok).select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest])
