"""Annotator-level jobs: deviation profile, extreme flags, counts, budgeted
subsample (J3, J4, J5, J13, J14, E1, E3, E6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.operators.running import running_totals
from raterlens.session import cut_lineage, spread
from raterlens.config import EXTREME_CUT, EXTREME_GAP, MIN_TEST, MIN_TRAIN


def text_means(ratings: DataFrame, text_id: str = "text_id", score: str = "y") -> DataFrame:
    return ratings.groupBy(text_id).agg(F.avg(F.col(score).cast("double")).alias("text_mean"))


def with_text_deviation(ratings: DataFrame, text_id: str = "text_id", score: str = "y") -> DataFrame:
    """Each rating minus the mean of its text (own rating included).

    Aggregate-then-join instead of a window: the aggregate is partial (a text
    holding a third of all rows does not land in one task) and the join side
    is one row per text; AQE splits a skewed join partition or broadcasts the
    means when they are small at run time."""
    means = text_means(ratings, text_id, score)
    return (ratings.join(means, text_id)
            .withColumn("deviation", F.col(score).cast("double") - F.col("text_mean")))


def annotator_profile(ratings: DataFrame, annotator: str = "annotator_id", text_id: str = "text_id",
                      score: str = "y", gap: float = EXTREME_GAP, cut: float = EXTREME_CUT) -> DataFrame:
    """Per annotator the distinct texts rated, mean deviation from the text
    mean, percent of ratings more than ``gap`` below (and above) it, and the
    strict ``percent_lower > cut`` extreme flag.

    The distinct count keeps every (annotator, text) pair of a task, so the
    ratings are dealt over as many tasks as they need."""
    d = with_text_deviation(spread(ratings.select(text_id, annotator, score), text_id), text_id, score)
    dev = F.col("deviation")
    prof = d.groupBy(annotator).agg(
        F.countDistinct(text_id).alias("n_annotated_texts"),
        F.avg(dev).alias("mean_deviation"),
        (F.lit(100.0) * F.avg((dev < -gap).cast("double"))).alias("percent_lower"),
        (F.lit(100.0) * F.avg((dev > gap).cast("double"))).alias("percent_higher"),
    )
    return prof.withColumn("extreme_annotator", F.col("percent_lower") > F.lit(cut))


def extreme_direction(profile: DataFrame, cut: float = EXTREME_CUT) -> DataFrame:
    """B7: 'lower' wins over 'higher'; otherwise 'no'."""
    return profile.select(
        "annotator_id",
        F.when(F.col("percent_lower") > cut, F.lit("lower"))
        .when(F.col("percent_higher") > cut, F.lit("higher"))
        .otherwise(F.lit("no")).alias("extreme_direction"))


def attach_direction(ratings: DataFrame, profile: DataFrame, cut: float = EXTREME_CUT) -> DataFrame:
    """Left join the direction to the ratings; raters missing from the
    profile are 'no'."""
    return (ratings.join(extreme_direction(profile, cut), "annotator_id", "left")
            .withColumn("extreme_direction", F.coalesce(F.col("extreme_direction"), F.lit("no"))))


def annotations_per_annotator(ratings: DataFrame, annotator: str = "annotator_id",
                              counted: str = "text_id") -> DataFrame:
    """Non-null count per annotator."""
    return ratings.groupBy(annotator).agg(F.count(counted).alias("n_annotations"))


def filter_min_annotations(ratings: DataFrame, min_total: int = MIN_TRAIN + MIN_TEST,
                           annotator: str = "annotator_id") -> DataFrame:
    """Keep the ratings of annotators with at least ``min_total`` ratings."""
    keep = (annotations_per_annotator(ratings, annotator)
            .filter(F.col("n_annotations") >= min_total).select(annotator))
    return ratings.join(keep, annotator, "left_semi")


def cumulative_annotations(train: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """Annotators ranked by train count (desc, id asc on ties) with the
    running annotator number and running annotation total.

    Totals run inside range partitions of the annotators and are shifted by
    those of the partitions before, so no task holds all annotators."""
    counts = annotations_per_annotator(train, annotator)
    return running_totals(counts, [("n_annotations", False), (annotator, True)], {
        "n_annotators_cumulative_sum": F.lit(1).cast("bigint"),
        "n_annotations_cumulative_sum": F.col("n_annotations")})


def budget_cut(cumulative: DataFrame, budget: int) -> DataFrame:
    """The annotator count whose cumulative total is nearest to the budget
    (first on ties). One row."""
    dist = F.abs(F.col("n_annotations_cumulative_sum") - F.lit(budget))
    return cumulative.agg(F.min_by("n_annotators_cumulative_sum",
                                   F.struct(dist, F.col("n_annotators_cumulative_sum"))).alias("k"))


def subsample_annotators(train: DataFrame, test: DataFrame, profile: DataFrame, budget: int,
                         annotator: str = "annotator_id"):
    """Keep, in both splits, the ratings of the top-K annotators (K from
    the budget cut) or of extreme annotators. The OR of two memberships is a
    union of the two id sets followed by one semi join."""
    cum = cut_lineage(cumulative_annotations(train, annotator))  # read for the cut and for the ids
    k = budget_cut(cum, budget).scalar()
    top = cum.filter(F.col("n_annotators_cumulative_sum") <= k).select(annotator)
    extreme = profile.filter(F.col("extreme_annotator")).select(annotator)
    keep = top.union(extreme).distinct()
    return train.join(keep, annotator, "left_semi"), test.join(keep, annotator, "left_semi")


def first_n_annotators(train: DataFrame, test: DataFrame, n: int, annotator: str = "annotator_id"):
    """Restrict both splits to the ``n`` smallest annotator ids of
    train (a top-n on distinct ids is the feature here)."""
    ids = train.select(annotator).distinct().orderBy(annotator).limit(n)
    return train.join(ids, annotator, "left_semi"), test.join(ids, annotator, "left_semi")
