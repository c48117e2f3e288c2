"""Combined prediction and the confidence-threshold sweep.

The combined label takes the boundary model's prediction when its confidence
reaches the threshold *and* it predicts 1 (asymmetric mode), otherwise the
personalised prediction. ``mode="symmetric"`` takes the boundary prediction
whenever its confidence is strictly above the threshold.

Sweep plan. For ascending thresholds t_0 < ... < t_{m-1} the override
condition is monotone in t, so each row is summarised by k = the number of
thresholds at which it is overridden: the row is overridden at t_i iff k > i.
Rows are first aggregated to counts by (group keys, y, personalised,
boundary, k) - a partial aggregate that collapses the fact to at most
|keys| x 2 x 2 x 2 x (m+1) rows - and only then exploded over thresholds.
No per-threshold job, no fan-out of the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlens.config import GROUP_ALL, GROUP_EXTREME, GROUP_NON_EXTREME, THRESHOLDS
from raterlens.functions.columns import nan_to_null, unique_on
from raterlens.operators.metrics import classification_report


def assemble_eval_fact(rows: DataFrame, boundary: DataFrame, profile: DataFrame) -> DataFrame:
    """Left join boundary predictions (by text) and extreme flags (by
    annotator) to the evaluated rows. A key that repeats on a right side
    would multiply rows and fails the job; AQE broadcasts the right sides
    when small at run time."""
    b = boundary.select("text_id", F.col("prediction").alias("boundary"),
                        nan_to_null("confidence_score").alias("confidence_score"))
    b = unique_on(b, "text_id")
    a = unique_on(profile.select("annotator_id", "extreme_annotator"), "annotator_id")
    return rows.join(b, "text_id", "left").join(a, "annotator_id", "left")


def combined_prediction(personalised, boundary, confidence, threshold, mode: str = "asymmetric") -> Column:
    """B9 as one column expression. NULL/NaN confidence or boundary keeps the
    personalised prediction."""
    p, b = F.col(personalised), F.col(boundary)
    c = nan_to_null(confidence)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if mode == "asymmetric":
        take = (c >= t) & (b == 1)
    elif mode == "symmetric":
        take = (c > t) & b.isNotNull()
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(F.coalesce(take, F.lit(False)), b).otherwise(p)


def override_level(boundary: str, confidence: str, thresholds: Sequence[int], mode: str = "asymmetric") -> Column:
    """Number of (ascending) thresholds at which the row is overridden."""
    b, c = F.col(boundary), nan_to_null(confidence)
    terms = []
    for t in sorted(thresholds):
        if mode == "asymmetric":
            cond = (c >= F.lit(t)) & (b == 1)
        else:
            cond = (c > F.lit(t)) & b.isNotNull()
        terms.append(F.when(F.coalesce(cond, F.lit(False)), F.lit(1)).otherwise(F.lit(0)))
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def group_names(flag: str = "extreme_annotator", with_all: bool = True) -> Column:
    """Array of group names a row belongs to: 'all' (optional) plus
    'extreme' / 'non_extreme'. A NULL flag belongs to 'all' only."""
    f = F.col(flag)
    parts = [F.lit(GROUP_ALL)] if with_all else []
    parts.append(F.when(f, F.lit(GROUP_EXTREME)).when(~f, F.lit(GROUP_NON_EXTREME)))
    return F.array_compact(F.array(*parts))


def sweep_counts(fact: DataFrame, keys: Sequence[str], thresholds: Sequence[int] = THRESHOLDS,
                 y: str = "y", personalised: str = "personalised", boundary: str = "boundary",
                 confidence: str = "confidence_score", mode: str = "asymmetric",
                 include_baseline: bool = False) -> DataFrame:
    """Weighted rows (keys, confidence_threshold, y, personalised, combined, n).

    With ``include_baseline`` one extra block with ``confidence_threshold``
    NULL carries the personalised prediction unchanged (the baseline)."""
    ts = sorted(int(t) for t in thresholds)
    pre = (fact.select(*keys, F.col(y).alias("__y"), F.col(personalised).alias("__p"),
                       F.col(boundary).alias("__b"),
                       override_level(boundary, confidence, ts, mode).alias("__k"))
           .groupBy(*keys, "__y", "__p", "__b", "__k").agg(F.count(F.lit(1)).alias("n")))
    entries = [F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(ts)]
    if include_baseline:
        entries.append(F.struct(F.lit(len(ts)).alias("i"), F.lit(None).cast("int").alias("t")))
    ex = pre.select("*", F.explode(F.array(*entries)).alias("__th"))
    combined = F.when(F.col("__k") > F.col("__th.i"), F.col("__b")).otherwise(F.col("__p"))
    return ex.select(*keys, F.col("__th.t").alias("confidence_threshold"), F.col("__y").alias("y"),
                     F.col("__p").alias("personalised"), combined.alias("combined"), "n")


def threshold_sweep_metrics(fact: DataFrame, thresholds: Sequence[int] = THRESHOLDS,
                            truth: str = "y", mode: str = "asymmetric",
                            zero_division: str = "zero") -> DataFrame:
    """J16 (J17 with ``truth`` = majority label): per group (all / extreme /
    non_extreme) and threshold: override fraction, accuracy, macro P/R/F1,
    support. One scan of the fact."""
    # counted by flag first: only the few counts are expanded to the groups
    sw = sweep_counts(fact, ["extreme_annotator"], thresholds, y=truth, mode=mode) \
        .select("*", F.explode(group_names()).alias("annotator_group")).drop("extreme_annotator")
    changed = F.when(~F.col("combined").eqNullSafe(F.col("personalised")), F.col("n")).otherwise(F.lit(0))
    rep = classification_report(sw, ["annotator_group", "confidence_threshold"], "y", "combined",
                                weight="n", zero_division=zero_division, extra={"n_overridden": changed})
    return rep.select("annotator_group", "confidence_threshold",
                      (F.col("n_overridden") / F.col("support")).alias("overridden_preds_frac"),
                      "accuracy", "precision", "recall", "f1_score", "support")


def grouped_counts(fact: DataFrame, truth: str = "y", prediction: str = "personalised") -> DataFrame:
    """Counts ``n`` of (y, p) per annotator group: by flag first, then the few
    counts are expanded to the groups."""
    c = fact.groupBy("extreme_annotator", F.col(truth).alias("y"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    return c.select(F.explode(group_names()).alias("annotator_group"), "y", "p", "n")


def baseline_metrics(fact: DataFrame, truth: str = "y", prediction: str = "personalised",
                     zero_division: str = "zero") -> DataFrame:
    """The personalised model alone, per group."""
    return classification_report(grouped_counts(fact, truth, prediction), ["annotator_group"], "y", "p", weight="n",
                                 zero_division=zero_division).drop("n_labels")


def override_fraction(fact: DataFrame, thresholds: Sequence[int] = THRESHOLDS,
                      mode: str = "asymmetric") -> DataFrame:
    """Share of rows whose combined label differs from the personalised one."""
    sw = sweep_counts(fact, [], thresholds, mode=mode)
    changed = F.when(~F.col("combined").eqNullSafe(F.col("personalised")), F.col("n")).otherwise(F.lit(0))
    return sw.groupBy("confidence_threshold").agg(
        (F.sum(changed) / F.sum("n")).alias("overridden_preds_frac"),
        F.sum("n").cast("bigint").alias("n_rows"))


def with_majority_label(fact: DataFrame, text_id: str = "text_id", label: str = "y",
                        out: str = "majority_label") -> DataFrame:
    """J17 input: attach the majority label of each text among the rows."""
    from raterlens.operators.labels import majority_labels

    m = majority_labels(fact, text_id, label).select(text_id, F.col("label").alias(out))
    return fact.join(m, text_id, "left")
