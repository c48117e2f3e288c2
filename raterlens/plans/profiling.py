"""Queries: annotator profile, directions, counts and budgeted subsamples
(J3-J5, J13, J14, C4, D1, D8-D10, D12, E1, E3, F2, F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.config import EXTREME_CUT, EXTREME_GAP, MIN_TEST, MIN_TRAIN, ORDER_RANGE
from raterlens.functions.columns import seeded_order
from raterlens.operators import annotators as ann
from raterlens.operators.distinct import distinct_counts
from raterlens.operators.labels import first_n_per_group
from raterlens.operators.running import join_groups, quantiles
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import seeded_order_sql
from raterlens.session import cut_lineage
from raterlens.sources import fixtures as fx

# Parameters of the registered queries (fixed here; the operators take any value).
SMALL_BUDGET = 10_000
FIRST_N = 100
SAMPLE_PER_GROUP = 5
SEED = 7


@query("annotator_profile", with_views("annotators") + """select annotator_id::bigint annotator_id,
  n_annotated_texts::bigint n_annotated_texts, round(mean_deviation, 6) mean_deviation,
  round(percent_lower, 6) percent_lower, round(percent_higher, 6) percent_higher, extreme_annotator
  from annotators""")
def annotator_profile(spark, sf):
    """Per annotator distinct texts, mean deviation, percent lower/higher, extreme flag."""
    return ann.annotator_profile(fx.ratings(spark, sf), score="y", gap=EXTREME_GAP, cut=EXTREME_CUT)


@query("text_mean_deviation", with_views("ratings") + """select text_id::bigint text_id,
  annotator_id::bigint annotator_id, y::bigint y, round(avg(y) over (partition by text_id), 6) text_mean,
  round(y - avg(y) over (partition by text_id), 6) deviation from ratings""")
def text_mean_deviation(spark, sf):
    """Each rating with its text mean and its deviation from it."""
    d = ann.with_text_deviation(fx.ratings(spark, sf))
    return d.select("text_id", "annotator_id", "y", "text_mean", "deviation")


_DIR_SQL = """{cut} label_cut, r.text_id, r.annotator_id, r.worker_id, r.y,
  coalesce(case when a.pl > 50 then 'lower' when a.ph > 50 then 'higher' end, 'no') extreme_direction
  from r{cut} r left join a{cut} a on r.annotator_id = a.annotator_id"""


def _direction_ctes(cut):
    return f"""r{cut} as (select text_id, annotator_id, worker_id, cast(toxic_score >= {cut} as int) y
  from ratings),
a{cut} as (select annotator_id, 100 * avg(cast(d < -0.5 as int)) pl, 100 * avg(cast(d > 0.5 as int)) ph
  from (select *, y - avg(y) over (partition by text_id) d from r{cut}) q group by annotator_id)"""


_DIRECTION = with_views("ratings", extra=_direction_ctes(2) + ",\n" + _direction_ctes(3) + """,
dirs as (select """ + _DIR_SQL.format(cut=2) + " union all select " + _DIR_SQL.format(cut=3) + ")")


def _directions(spark, sf):
    out = None
    for cut in (2, 3):
        r = fx.ratings(spark, sf, cut)
        prof = ann.annotator_profile(r)
        d = ann.attach_direction(r, prof).select(
            F.lit(cut).alias("label_cut"), "text_id", "annotator_id", "worker_id", "y", "extreme_direction")
        out = d if out is None else out.unionByName(d)
    return out


@query("extreme_direction", _DIRECTION + """select label_cut::bigint label_cut, text_id::bigint text_id,
  annotator_id::bigint annotator_id, worker_id, y::bigint y, extreme_direction from dirs""")
def extreme_direction(spark, sf):
    """Higher / lower / no per rater ('lower' wins), joined to the
    ratings, for label cuts 2 and 3."""
    return _directions(spark, sf)


@query("extreme_fraction", _DIRECTION + """select label_cut::bigint label_cut, extreme_direction,
  count(*)::bigint n_rows, round(count(*) / sum(count(*)) over (partition by label_cut), 6) frac_rows,
  count(distinct annotator_id)::bigint n_annotators from dirs group by label_cut, extreme_direction""")
def extreme_fraction(spark, sf):
    """Rows and annotators per direction, fraction of rows."""
    d = _directions(spark, sf)
    g = d.groupBy("label_cut", "extreme_direction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("annotator_id").alias("n_annotators"))
    tot = d.groupBy("label_cut").agg(F.count(F.lit(1)).alias("__t"))
    return g.join(tot, "label_cut").select("label_cut", "extreme_direction", "n_rows",
                                           (F.col("n_rows") / F.col("__t")).alias("frac_rows"), "n_annotators")


@query("annotations_per_annotator", with_views("ratings") + """select annotator_id::bigint annotator_id,
  count(text_id)::bigint n_annotations from ratings group by annotator_id""")
def annotations_per_annotator(spark, sf):
    """Ratings per annotator."""
    return ann.annotations_per_annotator(fx.ratings(spark, sf))


@query("annotation_count_distribution", with_views("ratings") + """select n_annotations::bigint n_annotations,
  count(*)::bigint n_annotators, round(count(*) / sum(count(*)) over (), 6) frac_annotators
  from (select annotator_id, count(*) n_annotations from ratings group by annotator_id) q
  group by n_annotations""")
def annotation_count_distribution(spark, sf):
    """Share of annotators having n ratings."""
    per = ann.annotations_per_annotator(fx.ratings(spark, sf))
    g = per.groupBy("n_annotations").agg(F.count(F.lit(1)).alias("n_annotators"))
    total = per.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("frac_annotators", F.col("n_annotators") / total)


@query("median_annotations", with_views("split_ratings") + """select split,
  round(median(n), 6) median_annotations, count(*)::bigint n_annotators
  from (select split, annotator_id, count(*) n from split_ratings group by split, annotator_id) q group by split""")
def median_annotations(spark, sf):
    """Median ratings per annotator in each split (exact, interpolated)."""
    per = fx.split_ratings(spark, sf).groupBy("split", "annotator_id").agg(F.count(F.lit(1)).alias("n"))
    per = cut_lineage(per)
    n = per.groupBy("split").agg(F.count(F.lit(1)).alias("n_annotators"))
    return join_groups(n, quantiles(per, ["split"], "n", {"median_annotations": 0.5}), ["split"]).select(
        "split", "median_annotations", "n_annotators")


@query("describe_annotations", with_views("ratings") + """select count(*)::bigint count, round(avg(n), 6) mean,
  round(stddev_samp(n), 6) std, min(n)::bigint min, round(quantile_cont(n, 0.25), 6) p25,
  round(quantile_cont(n, 0.5), 6) p50, round(quantile_cont(n, 0.75), 6) p75, max(n)::bigint max
  from (select annotator_id, count(*) n from ratings group by annotator_id) q""")
def describe_annotations(spark, sf):
    """Five-number summary, mean and sample std of ratings per annotator."""
    per = cut_lineage(ann.annotations_per_annotator(fx.ratings(spark, sf)).select(F.col("n_annotations").alias("n")))
    moments = per.agg(F.count(F.lit(1)).alias("count"), F.avg("n").alias("mean"),
                      F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))
    q = quantiles(per, [], "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_groups(moments, q, []).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


@query("dataset_cardinalities", with_views("ratings") + """select count(*)::bigint n_rows,
  count(distinct text_id)::bigint n_texts, count(distinct annotator_id)::bigint n_annotators,
  count(distinct worker_id)::bigint n_workers from ratings""")
def dataset_cardinalities(spark, sf):
    """Global distinct counts (exact)."""
    r = fx.ratings(spark, sf)
    n = r.agg(F.count(F.lit(1))).scalar()
    counts = distinct_counts(r, ["text_id", "annotator_id", "worker_id"])
    return counts.select(n.alias("n_rows"), F.col("text_id").alias("n_texts"), F.col("annotator_id").alias("n_annotators"),
                         F.col("worker_id").alias("n_workers"))


@query("filter_min_annotations", with_views("ratings") + f"""select text_id::bigint text_id,
  annotator_id::bigint annotator_id, y::bigint y from ratings where annotator_id in
  (select annotator_id from ratings group by annotator_id having count(*) >= {MIN_TRAIN + MIN_TEST})""")
def filter_min_annotations(spark, sf):
    """Ratings of annotators with at least 12 + 6 ratings."""
    return ann.filter_min_annotations(fx.ratings(spark, sf)).select("text_id", "annotator_id", "y")


_CUM_SQL = """cum as (select annotator_id, n_annotations,
  row_number() over (order by n_annotations desc, annotator_id) n_annotators_cumulative_sum,
  sum(n_annotations) over (order by n_annotations desc, annotator_id rows between unbounded preceding and current row)
    n_annotations_cumulative_sum
  from (select annotator_id, count(text_id) n_annotations from train_ratings group by annotator_id) q)"""


@query("cumulative_annotations", with_views("train_ratings", extra=_CUM_SQL) + """select
  annotator_id::bigint annotator_id, n_annotations::bigint n_annotations,
  n_annotators_cumulative_sum::bigint n_annotators_cumulative_sum,
  n_annotations_cumulative_sum::bigint n_annotations_cumulative_sum from cum""")
def cumulative_annotations(spark, sf):
    """Annotators by descending train count with running totals."""
    return ann.cumulative_annotations(fx.train_ratings(spark, sf))


@query("subsample_annotators", with_views("split_ratings", "annotators", extra=_CUM_SQL.replace(
    "from train_ratings", "from split_ratings where split = 'train'") + f""",
k as (select n_annotators_cumulative_sum k from cum
  order by abs(n_annotations_cumulative_sum - {SMALL_BUDGET}), n_annotators_cumulative_sum limit 1),
keep as (select annotator_id from cum where n_annotators_cumulative_sum <= (select k from k)
  union select annotator_id from annotators where extreme_annotator)""") + """select split,
  text_id::bigint text_id, annotator_id::bigint annotator_id, y::bigint y from split_ratings
  where annotator_id in (select annotator_id from keep)""")
def subsample_annotators(spark, sf):
    """Top-K annotators nearest a 10,000-row train budget, plus every
    extreme annotator, in both splits."""
    s = fx.split_ratings(spark, sf)
    train = s.filter(F.col("split") == "train")
    test = s.filter(F.col("split") == "test")
    tr, te = ann.subsample_annotators(train, test, fx.annotators(spark, sf), SMALL_BUDGET)
    return tr.unionByName(te).select("split", "text_id", "annotator_id", "y")


@query("first_n_annotators", with_views("split_ratings") + f"""select split, text_id::bigint text_id,
  annotator_id::bigint annotator_id from split_ratings where annotator_id in
  (select distinct annotator_id from split_ratings where split = 'train' order by annotator_id limit {FIRST_N})""")
def first_n_annotators(spark, sf):
    """Both splits restricted to the first 100 annotator ids of train."""
    s = fx.split_ratings(spark, sf)
    tr, te = ann.first_n_annotators(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"), FIRST_N)
    return tr.unionByName(te).select("split", "text_id", "annotator_id")


@query("sample_annotators", with_views("annotators") + f"""select extreme_annotator, annotator_id::bigint
  annotator_id from (select *, row_number() over (partition by extreme_annotator
  order by {seeded_order_sql('annotator_id', SEED)}, annotator_id) rn
  from annotators) q where rn <= {SAMPLE_PER_GROUP}""")
def sample_annotators(spark, sf):
    """5 annotators per extreme flag, without replacement, seeded."""
    a = fx.annotators(spark, sf).select("extreme_annotator", "annotator_id")
    a = a.withColumn("__ord", seeded_order("annotator_id", SEED)).withColumn("__n", F.lit(SAMPLE_PER_GROUP))
    return first_n_per_group(a, "extreme_annotator", "__ord", "annotator_id", "__n", ORDER_RANGE).select(
        "extreme_annotator", "annotator_id")
