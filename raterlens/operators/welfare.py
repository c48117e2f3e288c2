"""Per-annotator welfare of the combined model and its summaries.

``annotator_welfare`` is the long table (annotator, threshold) -> predictions,
overrides, macro-F1 of the combined and of the personalised prediction.
Everything else aggregates that table, which has one row per annotator and
threshold; no job touches the fact table again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raterlens.config import OVERRIDE_SHARE, SELECTED_THRESHOLDS, THRESHOLDS
from raterlens.functions.columns import pct
from raterlens.operators.combine import group_names, sweep_counts
from raterlens.operators.metrics import classification_report
from raterlens.operators.running import join_groups, quantiles
from raterlens.session import spread


def annotator_welfare(fact: DataFrame, thresholds: Sequence[int] = THRESHOLDS, truth: str = "y",
                      mode: str = "asymmetric", zero_division: str = "null") -> DataFrame:
    """One row per (annotator, threshold). The baseline is computed in the
    same sweep (a NULL-threshold block) and spread to the rows of its
    annotator by a window partitioned by annotator (8 rows per partition key).
    The rows are dealt by annotator first: an annotator's few rows hardly
    collapse before that, and all that follows is keyed by it."""
    f = spread(fact.select("annotator_id", "extreme_annotator", F.col(truth).alias("__truth"),
                           "personalised", "boundary", "confidence_score"), "annotator_id")
    sw = sweep_counts(f, ["annotator_id", "extreme_annotator"], thresholds, y="__truth", mode=mode,
                      include_baseline=True)
    changed = F.when(~F.col("combined").eqNullSafe(F.col("personalised")), F.col("n")).otherwise(F.lit(0))
    rep = classification_report(sw, ["annotator_id", "extreme_annotator", "confidence_threshold"],
                                "y", "combined", weight="n", zero_division=zero_division,
                                extra={"n_overridden": changed})
    base = F.max(F.when(F.col("confidence_threshold").isNull(), F.col("f1_score"))).over(
        W.partitionBy("annotator_id"))
    return (rep.withColumn("macro_f1_baseline", base)
            .filter(F.col("confidence_threshold").isNotNull())
            .select("annotator_id", "extreme_annotator", "confidence_threshold",
                    F.col("support").alias("n_preds_total"),
                    F.col("n_overridden").alias("n_overridden_preds"),
                    F.col("f1_score").alias("macro_f1"), "macro_f1_baseline"))


def welfare_summary(welfare: DataFrame) -> DataFrame:
    """Per threshold, percent of annotators with >= 1 override, improving,
    getting worse (strict), median positive / negative F1 change, total."""
    better = F.col("macro_f1") > F.col("macro_f1_baseline")
    worse = F.col("macro_f1") < F.col("macro_f1_baseline")
    delta = F.col("macro_f1") - F.col("macro_f1_baseline")
    n = F.count(F.lit(1))
    g = ["confidence_threshold"]
    out = welfare.groupBy("confidence_threshold").agg(
        pct(F.count_if(F.col("n_overridden_preds") >= 1), n).alias("perc_annotators_with_overrides"),
        pct(F.count_if(better), n).alias("perc_annotators_improving"),
        pct(F.count_if(worse), n).alias("perc_annotators_getting_worse"),
        n.cast("bigint").alias("n_annotators_total"),
    )
    # both medians in one plan: the sign of the change is a group of its own
    moved = welfare.filter(better | worse).select(*g, F.signum(delta).alias("__side"), delta.alias("__d"))
    m = quantiles(moved, [*g, "__side"], "__d", {"__m": 0.5}).groupBy(*g).agg(
        F.bround(F.max(F.when(F.col("__side") > 0, F.col("__m"))), 2).alias("macro_f1_delta_increase_median"),
        F.bround(F.max(F.when(F.col("__side") < 0, F.col("__m"))), 2).alias("macro_f1_delta_decrease_median"))
    out = join_groups(out, m, g, "left")
    return out.select("confidence_threshold", "perc_annotators_with_overrides", "perc_annotators_improving",
                      "perc_annotators_getting_worse", "macro_f1_delta_increase_median",
                      "macro_f1_delta_decrease_median", "n_annotators_total")


def welfare_summary_selected(welfare: DataFrame, selected: Sequence[int] = SELECTED_THRESHOLDS) -> DataFrame:
    """J20 selected view: the summary at the chosen thresholds."""
    return (welfare_summary(welfare.filter(F.col("confidence_threshold").isin(list(selected))))
            .drop("n_annotators_total"))


def _grouped(welfare: DataFrame, with_all: bool = True) -> DataFrame:
    return welfare.select(F.explode(group_names(with_all=with_all)).alias("annotator_group"), "*")


def welfare_f1_curve(welfare: DataFrame) -> DataFrame:
    """Annotator-averaged macro-F1 per (group, threshold) and the
    averaged baseline of the same annotators."""
    return _grouped(welfare).groupBy("annotator_group", "confidence_threshold").agg(
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.avg("macro_f1_baseline").alias("mean_macro_f1_baseline"),
        F.count(F.lit(1)).cast("bigint").alias("n_annotators"))


def override_rule(rule: str, share: float = OVERRIDE_SHARE) -> Column:
    """The studied notebooks use four rules to call an annotator
    overridden at a threshold."""
    n_o, n_t = F.col("n_overridden_preds"), F.col("n_preds_total")
    if rule == "any":
        return n_o >= 1
    if rule == "zero":
        return n_o == 0
    if rule == "share":
        return n_o > F.lit(share) * n_t
    if rule == "ceil_share":
        return n_o >= F.ceil(F.lit(share) * n_t)
    raise ValueError(f"unknown rule {rule!r}")


def overridden_annotator_fraction(welfare: DataFrame, rule: str = "any") -> DataFrame:
    """Fraction of annotators overridden per (group, threshold); the
    boundary model's acceptance is 100 - threshold."""
    return _grouped(welfare).groupBy("annotator_group", "confidence_threshold").agg(
        F.avg(override_rule(rule).cast("double")).alias("frac_overridden_annotators"),
        F.count(F.lit(1)).cast("bigint").alias("n_annotators"),
    ).withColumn("boundary_model_acceptance", F.lit(100) - F.col("confidence_threshold"))


def override_share_median(welfare: DataFrame) -> DataFrame:
    """Among annotators with >= 1 override, the median share of their
    predictions that was overridden, per (threshold, flag)."""
    w = welfare.filter(F.col("n_overridden_preds") >= 1)
    g = ["confidence_threshold", "extreme_annotator"]
    w = w.select(*g, (F.col("n_overridden_preds") / F.col("n_preds_total")).alias("__s"))
    n = w.groupBy(*g).agg(F.count(F.lit(1)).cast("bigint").alias("n_annotators"))
    m = quantiles(w, g, "__s", {"median_frac_overridden_preds": 0.5})
    return join_groups(n, m, g, "left").select(*g, "median_frac_overridden_preds", "n_annotators")


def welfare_subset(welfare: DataFrame, rule: str) -> DataFrame:
    """Mean macro-F1, count and the (changing) mean baseline of the
    annotators that satisfy ``rule`` at each threshold, per flag."""
    return (welfare.filter(override_rule(rule))
            .groupBy("extreme_annotator", "confidence_threshold").agg(
                F.avg("macro_f1").alias("mean_macro_f1"),
                F.count("macro_f1").cast("bigint").alias("n_annotators"),
                F.avg("macro_f1_baseline").alias("mean_macro_f1_baseline")))


def better_worse_off(welfare: DataFrame) -> DataFrame:
    """Per (flag, threshold) and population (all annotators, or only
    those with >= 1 override): better / worse off counts and fractions."""
    pops = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_overridden_preds") >= 1, F.lit("overridden"))))
    w = welfare.select(F.explode(pops).alias("population"), "*")
    better = (F.col("macro_f1") > F.col("macro_f1_baseline"))
    worse = (F.col("macro_f1") < F.col("macro_f1_baseline"))
    return w.groupBy("population", "extreme_annotator", "confidence_threshold").agg(
        F.count_if(better).cast("bigint").alias("n_better_off"),
        F.count_if(worse).cast("bigint").alias("n_worse_off"),
        F.count(F.lit(1)).cast("bigint").alias("n_annotators"),
        F.avg(better.cast("double")).alias("frac_better_off"),
        F.avg(worse.cast("double")).alias("frac_worse_off"))


def net_gain_all(welfare: DataFrame) -> DataFrame:
    """Better - worse per (flag, threshold), absolute and divided by the
    number of annotators with that flag."""
    better = F.count_if(F.col("macro_f1") > F.col("macro_f1_baseline"))
    worse = F.count_if(F.col("macro_f1") < F.col("macro_f1_baseline"))
    g = welfare.groupBy("extreme_annotator", "confidence_threshold").agg(
        (better - worse).cast("bigint").alias("net_annotators_gain"),
        F.count(F.lit(1)).cast("bigint").alias("n_annotators"))
    return g.withColumn("net_annotators_gain_frac", F.col("net_annotators_gain") / F.col("n_annotators"))


def net_gain_subset(welfare: DataFrame) -> DataFrame:
    """J27 on annotators with >= 1 override: divided by their count."""
    return net_gain_all(welfare.filter(F.col("n_overridden_preds") >= 1))


def welfare_long(welfare: DataFrame) -> DataFrame:
    """H1: (annotator, threshold, metric name, value) via unpivot."""
    return welfare.unpivot(["annotator_id", "confidence_threshold"],
                           ["macro_f1", "macro_f1_baseline"], "metric", "value")


def welfare_wide(welfare: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """H3: one row per annotator, one macro-F1 column per threshold (explicit
    pivot values, so no extra job discovers them)."""
    return (welfare.groupBy("annotator_id")
            .pivot("confidence_threshold", [int(t) for t in thresholds])
            .agg(F.max("macro_f1"))
            .select("annotator_id", *[F.col(str(t)).alias(f"macro_f1_{t}") for t in thresholds]))
