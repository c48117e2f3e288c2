"""Queries: external benchmark assembly, positional attach, sweep, welfare
and sampled trajectories (C8, J28-J30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.config import OVERRIDE_SHARE
from raterlens.operators import benchmark as bm
from raterlens.operators import stats as st
from raterlens.operators import welfare as wf
from raterlens.plans import welfare as wf_sql
from raterlens.plans.base import query
from raterlens.plans.evaluation import _REP_OUT
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import groups_cte, report_ctes, seeded_order_sql, sweep_cte
from raterlens.sources import fixtures as fx

SEED = 7
PER_GROUP = 5


def _cases(spark, sf):
    c = fx.bench_cases(spark, sf)
    # The boundary predictions arrive as an unkeyed file written in case order.
    return c.select("case_id", "label_gold"), c.select("case_id", "class_label", "confidence_score")


def _fact(spark, sf):
    cases, boundary = _cases(spark, sf)
    return bm.assemble_benchmark(fx.bench_catalog(spark, sf), cases, boundary, fx.annotators(spark, sf))


_MAPPED = """select case_id, case label_gold when 'hateful' then 1 when 'non-hateful' then 0 end label_gold,
  case class_label when '1' then 1 when 'yes' then 1 when 'no' then 0 end boundary, confidence_score
  from bench_cases"""


@query("positional_join", with_views("bench_cases") + """select case_id::bigint case_id,
  label_gold::bigint label_gold, boundary::bigint boundary, round(confidence_score, 6) confidence_score
  from (""" + _MAPPED + ") q")
def positional_join(spark, sf):
    """Boundary predictions (no key, case order) glued to the cases by row
    position; counts must agree."""
    cases, boundary = _cases(spark, sf)
    return bm.positional_join(bm.benchmark_cases(cases), bm.boundary_predictions(boundary),
                              ["case_id"], ["case_id"])


@query("benchmark_assembly", with_views("bench_fact") + """select annotator_id::bigint annotator_id,
  case_id::bigint case_id, personalised::bigint personalised, y::bigint label_gold, boundary::bigint boundary,
  round(confidence_score, 6) confidence_score, extreme_annotator from bench_fact""")
def benchmark_assembly(spark, sf):
    """Catalog x cases fact with gold, boundary prediction and flag
    (assembled here from its parts; the sweeps read the stored copy)."""
    return _fact(spark, sf)


@query("benchmark_sweep", with_views("bench_fact", extra=(
    sweep_cte("sw", "bench_fact") + ",\n" + groups_cte("g", "sw") + ",\n"
    + report_ctes("rep", "g", ["annotator_group", "confidence_threshold"], "y", "combined") + """,
ov as (select annotator_group, confidence_threshold,
  avg(case when combined is distinct from personalised then 1.0 else 0.0 end) frac
  from g group by annotator_group, confidence_threshold)""")) + f"""select rep.annotator_group,
  rep.confidence_threshold::bigint confidence_threshold, round(ov.frac, 6) overridden_preds_frac, {_REP_OUT}
  from rep join ov on rep.annotator_group = ov.annotator_group and rep.confidence_threshold = ov.confidence_threshold""")
def benchmark_sweep(spark, sf):
    """Sweep on the external benchmark against the gold label."""
    return bm.benchmark_sweep(fx.bench_fact(spark, sf))


BENCH_WELFARE_SQL = with_views("bench_fact", extra=(
    sweep_cte("sw", "bench_fact") + ",\n"
    + report_ctes("wr", "sw", ["annotator_id", "extreme_annotator", "confidence_threshold"], "y", "combined") + ",\n"
    + report_ctes("br", "bench_fact", ["annotator_id"], "y", "personalised") + """,
ov as (select annotator_id, confidence_threshold,
  count(*) filter (where combined is distinct from personalised) n_ov from sw
  group by annotator_id, confidence_threshold),
welfare as (select wr.annotator_id, wr.extreme_annotator, wr.confidence_threshold,
  wr.support n_preds_total, ov.n_ov n_overridden_preds, wr.f1_score macro_f1, br.f1_score macro_f1_baseline
  from wr join br on wr.annotator_id = br.annotator_id
  join ov on wr.annotator_id = ov.annotator_id and wr.confidence_threshold = ov.confidence_threshold)"""))


@query("benchmark_welfare", BENCH_WELFARE_SQL + """select annotator_id::bigint annotator_id, extreme_annotator,
  confidence_threshold::bigint confidence_threshold, n_preds_total::bigint n_preds_total,
  n_overridden_preds::bigint n_overridden_preds, round(macro_f1, 6) macro_f1,
  round(macro_f1_baseline, 6) macro_f1_baseline from welfare""")
def benchmark_welfare(spark, sf):
    """Per annotator and threshold welfare on the external benchmark."""
    return bm.benchmark_welfare(fx.bench_fact(spark, sf))


@query("sample_trajectories", BENCH_WELFARE_SQL + f""", pick as (select annotator_id from
  (select annotator_id, row_number() over (partition by extreme_annotator
    order by {seeded_order_sql('annotator_id', SEED)}, annotator_id) rn
   from (select distinct annotator_id, extreme_annotator from welfare where extreme_annotator is not null) q) q2
  where rn <= {PER_GROUP})
select extreme_annotator, annotator_id::bigint annotator_id, confidence_threshold::bigint confidence_threshold,
  round(macro_f1, 6) macro_f1 from welfare where annotator_id in (select annotator_id from pick)""")
def sample_trajectories(spark, sf):
    """Macro-F1 over thresholds of 5 seeded annotators per extreme flag."""
    return bm.sample_trajectories(bm.benchmark_welfare(fx.bench_fact(spark, sf)), PER_GROUP, SEED)


@query("benchmark_welfare_summary", BENCH_WELFARE_SQL + wf_sql.SUMMARY_SELECT)
def benchmark_welfare_summary(spark, sf):
    """The welfare summary on the external benchmark."""
    return wf.welfare_summary(bm.benchmark_welfare(fx.bench_fact(spark, sf)))


@query("benchmark_welch_ttest", BENCH_WELFARE_SQL + wf_sql.WELCH_SELECT)
def benchmark_welch_ttest(spark, sf):
    """Welch tests of threshold 100 against the others on the benchmark."""
    return st.welch_ttest(bm.benchmark_welfare(fx.bench_fact(spark, sf)), ["extreme_annotator"],
                          "confidence_threshold", "macro_f1", 100)


@query("benchmark_overridden_fraction", BENCH_WELFARE_SQL
       + wf_sql.fraction_select(f"n_overridden_preds > {OVERRIDE_SHARE} * n_preds_total"))
def benchmark_overridden_fraction(spark, sf):
    """Annotators with overrides on more than 5 % of their predictions."""
    return wf.overridden_annotator_fraction(bm.benchmark_welfare(fx.bench_fact(spark, sf)), rule="share")


@query("benchmark_f1_curve", BENCH_WELFARE_SQL + wf_sql.CURVE_SELECT)
def benchmark_f1_curve(spark, sf):
    """Annotator-averaged macro-F1 per group and threshold on the benchmark."""
    return wf.welfare_f1_curve(bm.benchmark_welfare(fx.bench_fact(spark, sf)))


@query("benchmark_overrides_by_group", BENCH_WELFARE_SQL + """select extreme_annotator,
  sum(n_preds_total)::bigint n_preds_total, sum(n_overridden_preds)::bigint n_overridden_preds,
  count(*)::bigint n_annotators from welfare where confidence_threshold = 85 group by extreme_annotator""")
def benchmark_overrides_by_group(spark, sf):
    """Predictions, overridden ones at threshold 85 and annotators per flag."""
    w = bm.benchmark_welfare(fx.bench_fact(spark, sf), thresholds=(85,))
    return w.groupBy("extreme_annotator").agg(
        F.sum("n_preds_total").alias("n_preds_total"), F.sum("n_overridden_preds").alias("n_overridden_preds"),
        F.count(F.lit(1)).alias("n_annotators"))
