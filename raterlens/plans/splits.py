"""Queries: text-disjoint train/test splits, their refinement, evaluation and
checks, best-of-N search and integer annotator ids (J6-J10, J32, G1-G5, C9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.config import MIN_TEST, MIN_TRAIN, TEST_FRACTION
from raterlens.operators import annotators as ann
from raterlens.operators import splits as sp
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import seeded_order_sql
from raterlens.sources import fixtures as fx

# Parameters of the registered queries (the operators take any value).
SEED = 7
N_TRIALS = 100


def _base(spark, sf):
    """Ratings of annotators with at least 12 + 6 ratings (J5), the input of the split."""
    r = fx.ratings(spark, sf).select("text_id", "annotator_id", "worker_id", "toxic_score", "y")
    return ann.filter_min_annotations(r)


def _split(spark, sf):
    # Used several times per query (raw and refined views, set checks):
    # written once so the cut-off subqueries run once.
    from raterlens.session import cut_lineage

    return cut_lineage(sp.split_on_texts(_base(spark, sf), TEST_FRACTION, SEED))


def _refined(spark, sf):
    return sp.refine_splits(_split(spark, sf), MIN_TRAIN)


def _order(seed_sql, text_id: str = "text_id") -> str:
    return seeded_order_sql(text_id, seed_sql)


_SPLIT_CTES = f"""base as (select text_id, annotator_id, worker_id, toxic_score, y from ratings
  where annotator_id in (select annotator_id from ratings group by annotator_id
    having count(*) >= {MIN_TRAIN + MIN_TEST})),
texts as (select distinct text_id from base),
tk as (select floor(cast({TEST_FRACTION} as double) * count(*)) k from texts),
rk as (select text_id, row_number() over (order by {_order(SEED)}, text_id) rn from texts),
sp as (select b.*, case when b.text_id in (select text_id from rk where rn <= (select k from tk))
  then 'test' else 'train' end split from base b),
cnt as (select annotator_id, count(*) filter (where split = 'train') n_train,
  count(*) filter (where split = 'test') n_test from sp group by annotator_id),
ref as (select * from sp where annotator_id in
  (select annotator_id from cnt where n_train >= {MIN_TRAIN} and n_test > 0))"""

SPLIT_SQL = with_views("ratings", extra=_SPLIT_CTES)


@query("split_on_texts", SPLIT_SQL + """select split, text_id::bigint text_id,
  annotator_id::bigint annotator_id, y::bigint y from sp""")
def split_on_texts(spark, sf):
    """20 % of the distinct texts (seeded) are test; rows follow their text."""
    return sp.split_on_texts(_base(spark, sf), TEST_FRACTION, SEED).select("split", "text_id", "annotator_id", "y")


@query("refine_splits", SPLIT_SQL + """select split, text_id::bigint text_id,
  annotator_id::bigint annotator_id, y::bigint y from ref""")
def refine_splits(spark, sf):
    """Both splits without annotators in one split only or with < 12 train ratings."""
    return _refined(spark, sf).select("split", "text_id", "annotator_id", "y")


_EVAL_SQL = f"""select stage, round(avg(case when split = 'test' then 1.0 else 0.0 end), 6) test_frac_samples,
  round(count(distinct case when split = 'test' then text_id end) / count(distinct text_id), 6) test_frac_text_ids,
  round((select count(*) filter (where n_train > 0 and n_test > 0) / count(*) from pa where pa.stage = e.stage), 6)
    annotators_in_both_splits_frac,
  round((select count(*) filter (where n_train > 0 and n_train < {MIN_TRAIN}) / count(*) filter (where n_train > 0)
    from pa where pa.stage = e.stage), 6) annotators_below_min_train_frac
  from ev e group by stage"""


@query("evaluate_splits", with_views("ratings", extra=_SPLIT_CTES + """,
ev as (select 'raw' stage, * from sp union all select 'refined' stage, * from ref),
pa as (select stage, annotator_id, count(*) filter (where split = 'train') n_train,
  count(*) filter (where split = 'test') n_test from ev group by stage, annotator_id)""") + _EVAL_SQL)
def evaluate_splits(spark, sf):
    """Test share of rows and of texts, annotators in both splits, share
    of train annotators below the minimum - for the raw and the refined split."""
    s = _split(spark, sf)
    raw = sp.evaluate_splits(s, MIN_TRAIN).withColumn("stage", F.lit("raw"))
    ref = sp.evaluate_splits(sp.refine_splits(s, MIN_TRAIN), MIN_TRAIN).withColumn("stage", F.lit("refined"))
    return raw.unionByName(ref)


@query("class_frequencies_by_split", with_views("ratings", extra=_SPLIT_CTES + """,
ev as (select 'raw' stage, * from sp union all select 'refined' stage, * from ref),
tot as (select stage, count(*) filter (where split = 'train') nt, count(*) filter (where split = 'test') ne
  from ev group by stage),
cf as (select stage, toxic_score, count(*) filter (where split = 'train') ct,
  count(*) filter (where split = 'test') ce from ev group by stage, toxic_score)""") + """select cf.stage,
  toxic_score::bigint toxic_score, round(ct / nt, 6) frac_train,
  round(case when ce > 0 then ce / ne end, 6) frac_test,
  round(abs(ct / nt - case when ce > 0 then ce / ne end), 6) abs_frac_diff
  from cf join tot on cf.stage = tot.stage where ct > 0""")
def class_frequencies_by_split(spark, sf):
    """Class fractions per split and their absolute difference."""
    s = _split(spark, sf)
    raw = sp.class_frequencies_by_split(s).withColumn("stage", F.lit("raw"))
    ref = sp.class_frequencies_by_split(sp.refine_splits(s, MIN_TRAIN)).withColumn("stage", F.lit("refined"))
    return raw.unionByName(ref)


@query("annotators_in_both", SPLIT_SQL + """select annotator_id::bigint annotator_id from sp where split = 'train'
  intersect select annotator_id::bigint annotator_id from sp where split = 'test'""")
def annotators_in_both(spark, sf):
    """Annotators found in both splits of the raw split."""
    return sp.annotators_in_both(_split(spark, sf))


@query("annotators_one_split_only", SPLIT_SQL + """select annotator_id::bigint annotator_id, 'train' only_in from
  (select annotator_id from sp where split = 'train' except select annotator_id from sp where split = 'test') a
  union all select annotator_id::bigint annotator_id, 'test' only_in from
  (select annotator_id from sp where split = 'test' except select annotator_id from sp where split = 'train') b""")
def annotators_one_split_only(spark, sf):
    """Annotators of the raw split found in one split only."""
    return sp.annotators_one_split_only(_split(spark, sf))


_SAME_SQL = """select stage, count(*) filter (where n_train > 0)::bigint n_train_annotators,
  count(*) filter (where n_test > 0)::bigint n_test_annotators,
  coalesce(bool_and((n_train > 0) = (n_test > 0)), true) same_annotators from pa group by stage"""


@query("same_annotators_check", with_views("ratings", extra=_SPLIT_CTES + """,
ev as (select 'raw' stage, * from sp union all select 'refined' stage, * from ref),
pa as (select stage, annotator_id, count(*) filter (where split = 'train') n_train,
  count(*) filter (where split = 'test') n_test from ev group by stage, annotator_id)""") + _SAME_SQL)
def same_annotators_check(spark, sf):
    """Are the annotator sets of train and test equal (raw vs refined)?"""
    s = _split(spark, sf)
    raw = sp.same_annotators(s).withColumn("stage", F.lit("raw"))
    ref = sp.same_annotators(sp.refine_splits(s, MIN_TRAIN)).withColumn("stage", F.lit("refined"))
    return raw.unionByName(ref)


@query("union_splits", SPLIT_SQL + """select 'train' split, text_id::bigint text_id, annotator_id::bigint annotator_id,
  y::bigint y, toxic_score::bigint toxic_score from ref where split = 'train'
  union all select 'test' split, text_id::bigint, annotator_id::bigint, y::bigint, null::bigint from ref
  where split = 'test'""")
def union_splits(spark, sf):
    """G1: stack train (with the raw score) and test (without it) by name."""
    r = _refined(spark, sf)
    train = r.filter(F.col("split") == "train").select("text_id", "annotator_id", "y", "toxic_score")
    test = r.filter(F.col("split") == "test").select("text_id", "annotator_id", "y")
    return sp.union_splits(train, test)


@query("assign_annotator_ids", SPLIT_SQL + """, ids as (select worker_id,
  row_number() over (order by worker_id) - 1 annotator_id from (select distinct worker_id from ref
  where split = 'train') q)
select r.split, r.text_id::bigint text_id, r.worker_id, ids.annotator_id::bigint annotator_id, r.y::bigint y
  from ref r join ids on r.worker_id = ids.worker_id""")
def assign_annotator_ids(spark, sf):
    """Dense annotator ids from the train raters, joined to both splits."""
    r = _refined(spark, sf).drop("annotator_id")
    return sp.assign_annotator_ids(r).select("split", "text_id", "worker_id", "annotator_id", "y")


@query("split_checks", SPLIT_SQL + f"""select
  (select count(*) from (select distinct text_id from ref) q)::bigint n_texts,
  (select round(avg(case when n = 2 then 1.0 else 0.0 end), 6)
     from (select text_id, count(annotator_id) n from ref group by text_id) q) frac_texts_two_ratings,
  count(*)::bigint n_annotators, round(avg(n_train + n_test), 6) mean_ratings_per_annotator,
  count(*) filter (where n_train > 0)::bigint n_train_annotators,
  count(*) filter (where n_test > 0)::bigint n_test_annotators,
  coalesce(bool_and((n_train > 0) = (n_test > 0)), true) same_annotators,
  round(median(case when n_train > 0 then n_train end), 6) median_train_per_annotator,
  round(median(case when n_test > 0 then n_test end), 6) median_test_per_annotator
  from (select annotator_id, count(*) filter (where split = 'train') n_train,
    count(*) filter (where split = 'test') n_test from ref group by annotator_id) pa""")
def split_checks(spark, sf):
    """Checks of the finished split: texts, annotators, two-rating texts,
    mean and median ratings per annotator, same annotators in both."""
    return sp.split_checks(_refined(spark, sf))


_TRIAL_SQL = with_views("ratings", extra=_SPLIT_CTES + f""",
tr as (select range trial from range({N_TRIALS})),
tt as (select t.trial, x.text_id,
  row_number() over (partition by t.trial order by {_order(f'({SEED} + t.trial)', 'x.text_id')}, x.text_id) rn,
  count(*) over (partition by t.trial) n from texts x cross join tr t),
tst as (select trial, text_id from tt where rn <= floor(cast({TEST_FRACTION} as double) * n)),
pc as (select t.trial, b.annotator_id, count(*) filter (where s.text_id is null) n_train,
  count(*) filter (where s.text_id is not null) n_test
  from base b cross join tr t left join tst s on s.trial = t.trial and s.text_id = b.text_id
  group by t.trial, b.annotator_id),
sc as (select t.trial, count(pc.annotator_id) n_annotators_kept, coalesce(sum(pc.n_train), 0) n_train_rows,
  coalesce(sum(pc.n_test), 0) n_test_rows from tr t
  left join pc on pc.trial = t.trial and pc.n_train >= {MIN_TRAIN} and pc.n_test > 0 group by t.trial),
obj as (select *, n_train_rows + n_test_rows objective from sc)""")


@query("best_split_trial", _TRIAL_SQL + """select trial::bigint trial, n_annotators_kept::bigint n_annotators_kept,
  n_train_rows::bigint n_train_rows, n_test_rows::bigint n_test_rows, objective::bigint objective,
  trial = (select trial from obj order by objective desc, trial limit 1) is_best from obj""")
def best_split_trial(spark, sf):
    """100 seeded splits scored in one pass (refined; objective = kept
    train + test rows); the earliest best trial is flagged."""
    return sp.split_trials(_base(spark, sf), N_TRIALS, TEST_FRACTION, SEED, MIN_TRAIN, "total")


@query("best_split", _TRIAL_SQL + f""", win as (select trial from obj order by objective desc, trial limit 1),
wt as (select text_id from tst where trial = (select trial from win)),
ws as (select b.*, case when b.text_id in (select text_id from wt) then 'test' else 'train' end split from base b),
wc as (select annotator_id, count(*) filter (where split = 'train') n_train,
  count(*) filter (where split = 'test') n_test from ws group by annotator_id),
wr as (select * from ws where annotator_id in
  (select annotator_id from wc where n_train >= {MIN_TRAIN} and n_test > 0)),
ids as (select worker_id, row_number() over (order by worker_id) - 1 annotator_id
  from (select distinct worker_id from wr where split = 'train') q)
select r.split, r.text_id::bigint text_id, r.worker_id, ids.annotator_id::bigint annotator_id, r.y::bigint y
  from wr r join ids on r.worker_id = ids.worker_id""")
def best_split(spark, sf):
    """The winning split of the 100 trials, refined, with dense
    annotator ids."""
    w = sp.best_split(_base(spark, sf), N_TRIALS, TEST_FRACTION, SEED, MIN_TRAIN, "total").drop("annotator_id")
    return sp.assign_annotator_ids(w).select("split", "text_id", "worker_id", "annotator_id", "y")
