"""Queries: combined prediction, threshold sweep and classification metrics
(B9, C1, H2, J16-J18, D15, D17-D20, D22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.config import THRESHOLDS
from raterlens.operators import combine as cmb
from raterlens.operators import metrics as met
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import groups_cte, report_ctes, sweep_cte
from raterlens.sources import fixtures as fx

FIXED_THRESHOLD = 85
_REP = "accuracy", '"precision"', "recall", "f1_score"
_REP_OUT = "round(accuracy, 6) accuracy, round(\"precision\", 6) \"precision\", round(recall, 6) recall, " \
           "round(f1_score, 6) f1_score, support::bigint support"


@query("left_join_annotator_flags", with_views("test_ratings", "annotators") + """select r.text_id::bigint text_id,
  r.annotator_id::bigint annotator_id, r.y::bigint y, a.extreme_annotator from test_ratings r
  left join annotators a on r.annotator_id = a.annotator_id""")
def left_join_annotator_flags(spark, sf):
    """Left lookup join of the extreme flag onto the test ratings."""
    a = fx.annotators(spark, sf).select("annotator_id", "extreme_annotator")
    return fx.test_ratings(spark, sf).select("text_id", "annotator_id", "y").join(a, "annotator_id", "left")


@query("combined_prediction", with_views("eval_rows") + f"""select text_id::bigint text_id,
  annotator_id::bigint annotator_id, personalised::bigint personalised, boundary::bigint boundary,
  confidence_score, (case when confidence_score >= {FIXED_THRESHOLD} and boundary = 1 then boundary
    else personalised end)::bigint combined,
  (case when confidence_score > {FIXED_THRESHOLD} and boundary is not null then boundary
    else personalised end)::bigint combined_symmetric from eval_rows""")
def combined_prediction(spark, sf):
    """Combined label at threshold 85 (asymmetric, as evaluated) and the
    symmetric variant."""
    e = fx.eval_rows(spark, sf)
    return e.select("text_id", "annotator_id", "personalised", "boundary", "confidence_score",
                    cmb.combined_prediction("personalised", "boundary", "confidence_score",
                                            FIXED_THRESHOLD).alias("combined"),
                    cmb.combined_prediction("personalised", "boundary", "confidence_score",
                                            FIXED_THRESHOLD, mode="symmetric").alias("combined_symmetric"))


@query("threshold_sweep", with_views("eval_rows", extra=sweep_cte("sw", "eval_rows")) + """select
  text_id::bigint text_id, annotator_id::bigint annotator_id, confidence_threshold::bigint confidence_threshold,
  combined::bigint combined from sw""")
def threshold_sweep(spark, sf):
    """H2/C11: every evaluated row at every threshold 70..100 step 5."""
    e = fx.eval_rows(spark, sf)
    t = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("confidence_threshold")
    x = e.select("text_id", "annotator_id", "personalised", "boundary", "confidence_score", t)
    return x.select("text_id", "annotator_id", "confidence_threshold",
                    cmb.combined_prediction("personalised", "boundary", "confidence_score",
                                            F.col("confidence_threshold")).alias("combined"))


def _sweep_sql(truth_view: str, truth: str) -> str:
    return with_views("eval_rows", extra=(
        (truth_view + ",\n" if truth_view else "")
        + sweep_cte("sw", "ev" if truth_view else "eval_rows") + ",\n"
        + groups_cte("g", "sw") + ",\n"
        + report_ctes("rep", "g", ["annotator_group", "confidence_threshold"], truth, "combined") + """,
ov as (select annotator_group, confidence_threshold,
  avg(case when combined is distinct from personalised then 1.0 else 0.0 end) frac
  from g group by annotator_group, confidence_threshold)""")) + f"""select rep.annotator_group,
  rep.confidence_threshold::bigint confidence_threshold, round(ov.frac, 6) overridden_preds_frac, {_REP_OUT}
  from rep join ov on rep.annotator_group = ov.annotator_group and rep.confidence_threshold = ov.confidence_threshold"""


@query("threshold_sweep_metrics", _sweep_sql("", "y"))
def threshold_sweep_metrics(spark, sf):
    """J16 (flagship): per group and threshold: override fraction, accuracy,
    macro P/R/F1, support - against the annotators' own labels."""
    return cmb.threshold_sweep_metrics(fx.eval_rows(spark, sf))


_MAJ_TRUTH = """mv as (select text_id, y majority_label from (select text_id, y,
  row_number() over (partition by text_id order by count(*) desc, y) rn from eval_rows group by text_id, y) q
  where rn = 1),
ev as (select e.*, mv.majority_label from eval_rows e left join mv on e.text_id = mv.text_id)"""


@query("threshold_sweep_majority", _sweep_sql(_MAJ_TRUTH, "majority_label"))
def threshold_sweep_majority(spark, sf):
    """The same sweep against the majority label of the evaluated rows."""
    e = cmb.with_majority_label(fx.eval_rows(spark, sf))
    return cmb.threshold_sweep_metrics(e, truth="majority_label")


@query("baseline_metrics", with_views("eval_rows", extra=groups_cte("g", "eval_rows") + ",\n"
                                      + report_ctes("rep", "g", ["annotator_group"], "y", "personalised"))
       + f"select annotator_group, {_REP_OUT} from rep")
def baseline_metrics(spark, sf):
    """The personalised model alone, per group."""
    return cmb.baseline_metrics(fx.eval_rows(spark, sf))


@query("override_fraction", with_views("eval_rows", extra=sweep_cte("sw", "eval_rows")) + """select
  confidence_threshold::bigint confidence_threshold,
  round(avg(case when combined is distinct from personalised then 1.0 else 0.0 end), 6) overridden_preds_frac,
  count(*)::bigint n_rows from sw group by confidence_threshold""")
def override_fraction(spark, sf):
    """Share of predictions changed by the boundary model, per threshold."""
    return cmb.override_fraction(fx.eval_rows(spark, sf))


@query("classification_report", with_views("eval_rows", extra=report_ctes("rep", "eval_rows", [], "y", "personalised"))
       + f"select {_REP_OUT}, n_labels::bigint n_labels from rep")
def classification_report(spark, sf):
    """Accuracy and macro P/R/F1/support of the personalised predictions."""
    return met.classification_report(fx.eval_rows(spark, sf), [], "y", "personalised")


@query("annotator_classification_report", with_views("eval_rows", extra=report_ctes(
    "rep", "eval_rows", ["annotator_id"], "y", "personalised", zero="null"))
    + f"select annotator_id::bigint annotator_id, {_REP_OUT}, n_labels::bigint n_labels from rep")
def annotator_classification_report(spark, sf):
    """Per-annotator report; undefined precision/recall is NULL and left
    out of the macro mean."""
    return met.classification_report(fx.eval_rows(spark, sf), ["annotator_id"], "y", "personalised",
                                     zero_division="null")


@query("macro_metrics", with_views("eval_rows", extra=groups_cte("g", "eval_rows") + ",\n"
                                   + report_ctes("rep", "g", ["annotator_group"], "y", "personalised", zero="null"))
       + """select annotator_group, round(accuracy, 6) accuracy, round(f1_score, 6) f1,
  round("precision", 6) "precision", round(recall, 6) recall from rep""")
def macro_metrics(spark, sf):
    """Accuracy, macro F1 / precision / recall (undefined -> skipped)."""
    e = fx.eval_rows(spark, sf)
    r = met.classification_report(cmb.grouped_counts(e), ["annotator_group"], "y", "p", weight="n",
                                  zero_division="null")
    return r.select("annotator_group", "accuracy", F.col("f1_score").alias("f1"), "precision", "recall")


@query("binary_f1", with_views("eval_rows", extra=groups_cte("g", "eval_rows")) + """select annotator_group,
  count(*) filter (where y = 1 and personalised = 1)::bigint tp,
  count(*) filter (where y <> 1 and personalised = 1)::bigint fp,
  count(*) filter (where y = 1 and personalised <> 1)::bigint fn,
  round(coalesce(2.0 * count(*) filter (where y = 1 and personalised = 1) / nullif(
    2 * count(*) filter (where y = 1 and personalised = 1) + count(*) filter (where y <> 1 and personalised = 1)
    + count(*) filter (where y = 1 and personalised <> 1), 0), 0), 6) f1 from g group by annotator_group""")
def binary_f1(spark, sf):
    """F1 of the positive class per group."""
    e = fx.eval_rows(spark, sf)
    return met.binary_f1(cmb.grouped_counts(e), ["annotator_group"], "y", "p", weight="n")


@query("overrides_by_group", with_views("eval_rows") + f"""select extreme_annotator,
  count(*)::bigint n_preds_total,
  count(*) filter (where confidence_score >= {FIXED_THRESHOLD} and boundary = 1
    and boundary <> personalised)::bigint n_overridden_preds,
  count(distinct annotator_id)::bigint n_annotators from eval_rows group by extreme_annotator""")
def overrides_by_group(spark, sf):
    """Predictions, overridden predictions at threshold 85 and annotators per flag."""
    e = fx.eval_rows(spark, sf)
    comb = cmb.combined_prediction("personalised", "boundary", "confidence_score", FIXED_THRESHOLD)
    return e.groupBy("extreme_annotator").agg(
        F.count(F.lit(1)).alias("n_preds_total"),
        F.count_if(~comb.eqNullSafe(F.col("personalised"))).alias("n_overridden_preds"),
        F.countDistinct("annotator_id").alias("n_annotators"))
