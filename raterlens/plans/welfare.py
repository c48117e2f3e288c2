"""Queries: per-annotator welfare and its summaries, reshapes and
statistics (J19-J27, H1, H3, D25-D28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.config import ORDER_DIGITS, ORDER_RANGE, SELECTED_THRESHOLDS, THRESHOLDS
from raterlens.operators import stats as st
from raterlens.operators import welfare as wf
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import groups_cte, report_ctes, sweep_cte
from raterlens.sources import fixtures as fx

WELFARE_SQL = with_views("eval_rows", extra=(
    sweep_cte("sw", "eval_rows") + ",\n"
    + report_ctes("wr", "sw", ["annotator_id", "extreme_annotator", "confidence_threshold"], "y", "combined",
                  zero="null") + ",\n"
    + report_ctes("br", "eval_rows", ["annotator_id"], "y", "personalised", zero="null") + """,
ov as (select annotator_id, confidence_threshold,
  count(*) filter (where combined is distinct from personalised) n_ov from sw
  group by annotator_id, confidence_threshold),
welfare as (select wr.annotator_id, wr.extreme_annotator, wr.confidence_threshold,
  wr.support n_preds_total, ov.n_ov n_overridden_preds, wr.f1_score macro_f1, br.f1_score macro_f1_baseline
  from wr join br on wr.annotator_id = br.annotator_id
  join ov on wr.annotator_id = ov.annotator_id and wr.confidence_threshold = ov.confidence_threshold)"""))


def _welfare(spark, sf):
    return wf.annotator_welfare(fx.eval_rows(spark, sf))


@query("annotator_welfare", WELFARE_SQL + """select annotator_id::bigint annotator_id, extreme_annotator,
  confidence_threshold::bigint confidence_threshold, n_preds_total::bigint n_preds_total,
  n_overridden_preds::bigint n_overridden_preds, round(macro_f1, 6) macro_f1,
  round(macro_f1_baseline, 6) macro_f1_baseline from welfare""")
def annotator_welfare(spark, sf):
    """Per annotator and threshold: predictions, overrides, macro-F1 of
    the combined and of the personalised prediction."""
    return _welfare(spark, sf)


_SUMMARY_COLS = """round_even(100.0 * count(*) filter (where n_overridden_preds >= 1) / count(*), 2)
    perc_annotators_with_overrides,
  round_even(100.0 * count(*) filter (where macro_f1 > macro_f1_baseline) / count(*), 2) perc_annotators_improving,
  round_even(100.0 * count(*) filter (where macro_f1 < macro_f1_baseline) / count(*), 2)
    perc_annotators_getting_worse,
  round_even(median(case when macro_f1 > macro_f1_baseline then macro_f1 - macro_f1_baseline end), 2)
    macro_f1_delta_increase_median,
  round_even(median(case when macro_f1 < macro_f1_baseline then macro_f1 - macro_f1_baseline end), 2)
    macro_f1_delta_decrease_median"""


# The same statements over the ``welfare`` CTE serve the external benchmark.
SUMMARY_SELECT = f"""select confidence_threshold::bigint confidence_threshold,
  {_SUMMARY_COLS}, count(*)::bigint n_annotators_total from welfare group by confidence_threshold"""


@query("welfare_summary", WELFARE_SQL + SUMMARY_SELECT)
def welfare_summary(spark, sf):
    """Per threshold: % annotators with overrides, improving, worse;
    median F1 gain and loss (2 decimals, half-even); total."""
    return wf.welfare_summary(_welfare(spark, sf))


_SEL = ", ".join(str(t) for t in SELECTED_THRESHOLDS)


@query("welfare_summary_selected", WELFARE_SQL + f"""select confidence_threshold::bigint confidence_threshold,
  {_SUMMARY_COLS} from welfare where confidence_threshold in ({_SEL}) group by confidence_threshold""")
def welfare_summary_selected(spark, sf):
    """The summary at thresholds 100, 95, 85, 80."""
    return wf.welfare_summary_selected(_welfare(spark, sf))


CURVE_SELECT = ", " + groups_cte("g", "welfare") + """
select annotator_group,
  confidence_threshold::bigint confidence_threshold, round(avg(macro_f1), 6) mean_macro_f1,
  round(avg(macro_f1_baseline), 6) mean_macro_f1_baseline, count(*)::bigint n_annotators
  from g group by annotator_group, confidence_threshold"""


@query("welfare_f1_curve", WELFARE_SQL + CURVE_SELECT)
def welfare_f1_curve(spark, sf):
    """Annotator-averaged macro-F1 per group and threshold, with the
    averaged baseline."""
    return wf.welfare_f1_curve(_welfare(spark, sf))


def fraction_select(overridden: str) -> str:
    return ", " + groups_cte("g", "welfare") + f"""
select annotator_group, confidence_threshold::bigint confidence_threshold,
  round(avg(case when {overridden} then 1.0 else 0.0 end), 6) frac_overridden_annotators,
  count(*)::bigint n_annotators, (100 - confidence_threshold)::bigint boundary_model_acceptance
  from g group by annotator_group, confidence_threshold"""


@query("overridden_annotator_fraction", WELFARE_SQL + fraction_select("n_overridden_preds >= 1"))
def overridden_annotator_fraction(spark, sf):
    """Fraction of annotators with >= 1 override, per group and threshold."""
    return wf.overridden_annotator_fraction(_welfare(spark, sf), rule="any")


@query("override_share_median", WELFARE_SQL + """select confidence_threshold::bigint confidence_threshold,
  extreme_annotator, round(median(n_overridden_preds / n_preds_total), 6) median_frac_overridden_preds,
  count(*)::bigint n_annotators from welfare where n_overridden_preds >= 1
  group by confidence_threshold, extreme_annotator""")
def override_share_median(spark, sf):
    """Median overridden share among annotators with overrides."""
    return wf.override_share_median(_welfare(spark, sf))


def _subset_sql(cond: str) -> str:
    return WELFARE_SQL + f"""select extreme_annotator, confidence_threshold::bigint confidence_threshold,
  round(avg(macro_f1), 6) mean_macro_f1, count(macro_f1)::bigint n_annotators,
  round(avg(macro_f1_baseline), 6) mean_macro_f1_baseline from welfare where {cond}
  group by extreme_annotator, confidence_threshold"""


@query("welfare_subset_zero", _subset_sql("n_overridden_preds = 0"))
def welfare_subset_zero(spark, sf):
    """Annotators with no override at the threshold."""
    return wf.welfare_subset(_welfare(spark, sf), "zero")


@query("welfare_subset_any", _subset_sql("n_overridden_preds >= 1"))
def welfare_subset_any(spark, sf):
    """Annotators with at least one override."""
    return wf.welfare_subset(_welfare(spark, sf), "any")


@query("welfare_subset_5pct", _subset_sql("n_overridden_preds >= ceil(n_preds_total * 0.05)"))
def welfare_subset_5pct(spark, sf):
    """Annotators with overrides on at least ceil(5 %) of their predictions."""
    return wf.welfare_subset(_welfare(spark, sf), "ceil_share")


@query("better_worse_off", WELFARE_SQL + """, pop as (select 'all' population, * from welfare
  union all select 'overridden' population, * from welfare where n_overridden_preds >= 1)
select population, extreme_annotator, confidence_threshold::bigint confidence_threshold,
  count(*) filter (where macro_f1 > macro_f1_baseline)::bigint n_better_off,
  count(*) filter (where macro_f1 < macro_f1_baseline)::bigint n_worse_off, count(*)::bigint n_annotators,
  round(avg(case when macro_f1 > macro_f1_baseline then 1.0 else 0.0 end), 6) frac_better_off,
  round(avg(case when macro_f1 < macro_f1_baseline then 1.0 else 0.0 end), 6) frac_worse_off
  from pop group by population, extreme_annotator, confidence_threshold""")
def better_worse_off(spark, sf):
    """Better / worse off (strict) per flag and threshold, for all
    annotators and for those with overrides."""
    return wf.better_worse_off(_welfare(spark, sf))


def _net_sql(where: str) -> str:
    return WELFARE_SQL + f"""select extreme_annotator, confidence_threshold::bigint confidence_threshold,
  (count(*) filter (where macro_f1 > macro_f1_baseline)
   - count(*) filter (where macro_f1 < macro_f1_baseline))::bigint net_annotators_gain,
  count(*)::bigint n_annotators,
  round((count(*) filter (where macro_f1 > macro_f1_baseline)
   - count(*) filter (where macro_f1 < macro_f1_baseline)) / count(*), 6) net_annotators_gain_frac
  from welfare {where} group by extreme_annotator, confidence_threshold"""


@query("net_gain_all", _net_sql(""))
def net_gain_all(spark, sf):
    """Net gain over all annotators of the flag."""
    return wf.net_gain_all(_welfare(spark, sf))


@query("net_gain_subset", _net_sql("where n_overridden_preds >= 1"))
def net_gain_subset(spark, sf):
    """Net gain over annotators with overrides."""
    return wf.net_gain_subset(_welfare(spark, sf))


@query("welfare_long", WELFARE_SQL + """select annotator_id::bigint annotator_id,
  confidence_threshold::bigint confidence_threshold, 'macro_f1' metric, round(macro_f1, 6) "value" from welfare
  union all select annotator_id, confidence_threshold, 'macro_f1_baseline', round(macro_f1_baseline, 6)
  from welfare""")
def welfare_long(spark, sf):
    """H1: welfare metrics as (annotator, threshold, metric, value) rows."""
    return wf.welfare_long(_welfare(spark, sf))


@query("welfare_wide", WELFARE_SQL + "select annotator_id::bigint annotator_id, " + ", ".join(
    f"round(max(case when confidence_threshold = {t} then macro_f1 end), 6) macro_f1_{t}" for t in THRESHOLDS)
    + " from welfare group by annotator_id")
def welfare_wide(spark, sf):
    """H3: one macro-F1 column per threshold."""
    return wf.welfare_wide(_welfare(spark, sf))


WELCH_SELECT = """, mom as (select extreme_annotator, confidence_threshold,
  avg(macro_f1) m, var_samp(macro_f1) v, count(macro_f1) n from welfare group by extreme_annotator, confidence_threshold),
j as (select a.extreme_annotator, a.m m_a, a.v / a.n se_a, a.n n_a, b.confidence_threshold threshold_b,
  b.m m_b, b.v / b.n se_b, b.n n_b from mom a join mom b on a.extreme_annotator = b.extreme_annotator
  where a.confidence_threshold = 100 and b.confidence_threshold <> 100),
wt as (select *, case when se_a + se_b > 0 then (m_a - m_b) / sqrt(se_a + se_b) end t,
  case when se_a * se_a / (n_a - 1) + se_b * se_b / (n_b - 1) > 0 then
    (se_a + se_b) * (se_a + se_b) / (se_a * se_a / (n_a - 1) + se_b * se_b / (n_b - 1)) end df from j)"""
_WELCH_COLUMNS = """extreme_annotator, 100::bigint threshold_a, threshold_b::bigint threshold_b, round(t, 6) t_stat,
  round(df, 6) dof, n_a::bigint n_a, n_b::bigint n_b"""

# The tail by the power series of the incomplete beta function (all terms
# positive), on the side of its argument below one half.
_SERIES = """, side as (select *, df / (df + t * t) x, x < 0.5 lower, case when lower then x else 1 - x end z,
  case when lower then df / 2 else 0.5 end a, case when lower then 0.5 else df / 2 end b from wt),
beta as (select extreme_annotator e, threshold_b tb, case when any_value(z) = 0 then 0 else
  exp(any_value(a * ln(nullif(z, 0)) + b * ln(1 - z) + lgamma(a + b) - lgamma(a) - lgamma(b)) - ln(any_value(a))) * sum(exp(
  lgamma(a + b + k) - lgamma(a + b) - lgamma(a + 1 + k) + lgamma(a + 1) + k * ln(nullif(z, 0)))) end i
  from side cross join range(0, 4000) r(k) where t is not null and df > 0 group by extreme_annotator, threshold_b)"""


@query("welch_ttest", WELFARE_SQL + WELCH_SELECT + f"select {_WELCH_COLUMNS} from wt")
def welch_ttest(spark, sf):
    """Welch t and degrees of freedom, threshold 100 against each
    other threshold, per extreme flag."""
    return st.welch_ttest(_welfare(spark, sf), ["extreme_annotator"], "confidence_threshold", "macro_f1", 100)


@query("welch_ttest_pvalue", WELFARE_SQL + WELCH_SELECT + _SERIES + f"""select {_WELCH_COLUMNS},
  round(case when i is null then 'nan'::double when lower then i else 1 - i end, 6) pvalue
  from side left join beta on extreme_annotator = e and threshold_b = tb""")
def welch_ttest_pvalue(spark, sf):
    """The Welch tests with two-sided p-values."""
    t = st.welch_ttest(_welfare(spark, sf), ["extreme_annotator"], "confidence_threshold", "macro_f1", 100)
    return st.with_welch_pvalue(t)


@query("boxplot_stats", WELFARE_SQL + """, q as (select confidence_threshold, extreme_annotator,
  quantile_cont(macro_f1, 0.25) q1, quantile_cont(macro_f1, 0.5) med, quantile_cont(macro_f1, 0.75) q3
  from welfare group by confidence_threshold, extreme_annotator)
select w.confidence_threshold::bigint confidence_threshold, w.extreme_annotator, round(q.q1, 6) q1,
  round(q.med, 6) median, round(q.q3, 6) q3,
  round(min(case when macro_f1 >= q.q1 - 1.5 * (q.q3 - q.q1) then macro_f1 end), 6) whisker_low,
  round(max(case when macro_f1 <= q.q3 + 1.5 * (q.q3 - q.q1) then macro_f1 end), 6) whisker_high,
  count(*) filter (where macro_f1 < q.q1 - 1.5 * (q.q3 - q.q1) or macro_f1 > q.q3 + 1.5 * (q.q3 - q.q1))::bigint
    n_outliers, count(macro_f1)::bigint n, round(q.q3 - q.q1, 6) iqr
from welfare w join q on w.confidence_threshold = q.confidence_threshold
  and w.extreme_annotator = q.extreme_annotator group by all""")
def boxplot_stats(spark, sf):
    """Box-plot statistics of annotator macro-F1 per threshold and flag."""
    return st.boxplot_stats(_welfare(spark, sf), ["confidence_threshold", "extreme_annotator"], "macro_f1")


@query("histogram_density", with_views("ratings", extra="""per as (select annotator_id, count(*) x from ratings
  group by annotator_id),
b as (select min(x) lo, max(x) hi, count(x) n, (max(x) - min(x)) / 20.0 w from per)""") + """select
  least(coalesce(floor((x - lo) / nullif(w, 0)), 0), 19)::bigint bin,
  round(any_value(lo + least(coalesce(floor((x - lo) / nullif(w, 0)), 0), 19) * w), 6) bin_start,
  round(any_value(lo + (least(coalesce(floor((x - lo) / nullif(w, 0)), 0), 19) + 1) * w), 6) bin_end,
  count(*)::bigint n_in_bin, round(count(*) / any_value(n * nullif(w, 0)), 6) density
  from per, b group by 1""")
def histogram_density(spark, sf):
    """Density histogram (20 equal-width bins) of ratings per annotator."""
    per = fx.ratings(spark, sf).groupBy("annotator_id").agg(F.count(F.lit(1)).alias("x"))
    return st.histogram_density(per, "x", 20)


_CI_REPS, _CI_SEED = 200, 3
_CI_WEIGHT = "case " + " ".join(f"when u < {p!r} then {k}" for k, p in enumerate(st.POISSON1_CDF)) \
    + f" else {len(st.POISSON1_CDF)} end"
# Every weight has a digest of its own.
_CI_ORDER = (f"('0x' || substr(md5(cast(annotator_id as varchar) || '_' || cast(({_CI_SEED * _CI_REPS} + rep) as varchar)), "
             f"1, {ORDER_DIGITS}))::bigint")


@query("mean_with_ci", WELFARE_SQL + f""", bw as (select confidence_threshold, extreme_annotator, macro_f1, rep, {_CI_WEIGHT} w
  from (select *, {_CI_ORDER} / {float(ORDER_RANGE)!r} u
    from welfare cross join (select range rep from range({_CI_REPS})) q) q2),
bm as (select confidence_threshold, extreme_annotator, rep, sum(w * macro_f1) / nullif(sum(case when macro_f1 is not null
    then w end), 0) m from bw group by confidence_threshold, extreme_annotator, rep),
ci as (select confidence_threshold, extreme_annotator, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi
  from bm group by confidence_threshold, extreme_annotator),
pt as (select confidence_threshold, extreme_annotator, avg(macro_f1) a, count(macro_f1) n
  from welfare group by confidence_threshold, extreme_annotator)
select pt.confidence_threshold::bigint confidence_threshold, pt.extreme_annotator, round(a, 6) mean, n::bigint n,
  round(lo, 6) ci_low, round(hi, 6) ci_high from pt join ci on pt.confidence_threshold = ci.confidence_threshold
  and pt.extreme_annotator = ci.extreme_annotator""")
def mean_with_ci(spark, sf):
    """Mean macro-F1 per threshold and flag with a 95 % Poisson-bootstrap
    interval (200 replicates)."""
    return st.mean_with_ci(_welfare(spark, sf), ["confidence_threshold", "extreme_annotator"],
                           "macro_f1", replicates=_CI_REPS, seed=_CI_SEED, key="annotator_id", own_digests=True)
