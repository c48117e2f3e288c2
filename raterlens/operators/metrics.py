"""Classification metrics as two hash aggregates (D17-D21, §2.12).

For one group the label set is distinct(y) ∪ distinct(ŷ) of that group. Per
label: tp, true (= support), pred; precision = tp/pred, recall = tp/true,
f1 = 2·tp/(true+pred). Macro = unweighted mean over the label set; accuracy =
Σtp/Σtrue. Undefined precision/recall (pred = 0 or true = 0) is 0 with
``zero_division="zero"`` and NULL (left out of the mean) with ``"null"``.
Macro-F1 is the same in both modes.

Inputs may carry a row weight (a count), so callers can pre-aggregate
(group keys, y, ŷ) before any fan-out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ("accuracy", "precision", "recall", "f1_score", "support")


def label_counts(df: DataFrame, keys: Sequence[str], y: str, yhat: str,
                 weight: str | None = None, extra: dict | None = None) -> DataFrame:
    """Per (keys, label): tp, n_true, n_pred. Rows with a NULL label are left
    out. ``extra`` maps names to per-row numeric columns that are summed along
    (carried on the true-label side only, so a later sum over labels gives the
    group total)."""
    extra = extra or {}
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    base = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = base.select(*keys, F.explode(F.array(
        F.struct(F.col(y).cast("bigint").alias("label"), w.alias("t"), zero.alias("p"),
                 F.when(F.col(y) == F.col(yhat), w).otherwise(zero).alias("tp"),
                 *[c.cast("bigint").alias(n) for n, c in extra.items()]),
        F.struct(F.col(yhat).cast("bigint").alias("label"), zero.alias("t"), w.alias("p"),
                 zero.alias("tp"), *[zero.alias(n) for n in extra]),
    )).alias("e"))
    return (e.groupBy(*keys, F.col("e.label").alias("label"))
            .agg(F.sum("e.tp").alias("tp"), F.sum("e.t").alias("n_true"), F.sum("e.p").alias("n_pred"),
                 *[F.sum(f"e.{n}").alias(n) for n in extra])
            .filter((F.col("n_true") + F.col("n_pred")) > 0))


def per_label_metrics(counts: DataFrame, zero_division: str = "zero") -> DataFrame:
    undefined: Column = F.lit(0.0) if zero_division == "zero" else F.lit(None).cast("double")
    tp = F.col("tp").cast("double")
    return counts.select(
        "*",
        F.when(F.col("n_pred") > 0, tp / F.col("n_pred")).otherwise(undefined).alias("precision"),
        F.when(F.col("n_true") > 0, tp / F.col("n_true")).otherwise(undefined).alias("recall"),
        (F.lit(2.0) * tp / (F.col("n_true") + F.col("n_pred"))).alias("f1_score"),
    )


def classification_report(df: DataFrame, keys: Sequence[str], y: str, yhat: str,
                          weight: str | None = None, zero_division: str = "zero",
                          extra: dict | None = None) -> DataFrame:
    """Accuracy and macro precision/recall/F1/support per group of ``keys``."""
    extra = extra or {}
    per_label = per_label_metrics(label_counts(df, keys, y, yhat, weight, extra), zero_division)
    return per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"),
        F.sum("n_true").cast("bigint").alias("support"),
        F.count(F.lit(1)).cast("bigint").alias("n_labels"),
        *[F.sum(n).cast("bigint").alias(n) for n in extra],
    )


def binary_f1(df: DataFrame, keys: Sequence[str], y: str, yhat: str, positive: int = 1,
              weight: str | None = None) -> DataFrame:
    """F1 of the positive class, 2tp/(2tp+fp+fn); 0 when undefined.
    ``weight`` counts a row as many times."""
    n = F.col(weight) if weight else F.lit(1)

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(F.lit(0))).cast("bigint")

    tp = total((F.col(y) == positive) & (F.col(yhat) == positive))
    fp = total((F.col(y) != positive) & (F.col(yhat) == positive))
    fn = total((F.col(y) == positive) & (F.col(yhat) != positive))
    g = df.groupBy(*keys) if keys else df
    out = g.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    den = F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumn("f1", F.when(den > 0, F.lit(2.0) * F.col("tp") / den).otherwise(F.lit(0.0)))
