"""DuckDB text of the fixture views, used as a CTE prefix by the oracle SQL.

Same definitions as :mod:`raterlens.sources.fixtures` (written independently
as SQL); see FIXTURES.md.
"""

from __future__ import annotations

VIEWS = {
    "ratings_raw": """select p_name || ' ' || cast(l_partkey as varchar) as comment,
  case when l_partkey % 10 = 0 then l_partkey - 1 else l_partkey end as comment_id,
  l_returnflag as source, 'w' || cast(o_custkey as varchar) as worker_id,
  cast(greatest(0, least(4, cast(floor((l_quantity - 1) / 10) as int)
    + case o_custkey % 10 when 0 then -2 when 1 then 2 else 0 end)) as int) as toxic_score,
  l_partkey as text_id, o_custkey as annotator_id
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "ratings": """select comment, comment_id, source, worker_id, toxic_score, text_id, annotator_id,
  cast(toxic_score >= 2 as int) as y from
  (select *, count(*) over (partition by text_id, annotator_id) n from ratings_raw) q where n = 1""",
    "annotators": """select annotator_id, count(distinct text_id) n_annotated_texts, avg(d) mean_deviation,
  100 * avg(cast(d < -0.5 as int)) percent_lower, 100 * avg(cast(d > 0.5 as int)) percent_higher,
  100 * avg(cast(d < -0.5 as int)) > 50 as extreme_annotator
from (select *, y - avg(y) over (partition by text_id) d from ratings) q group by annotator_id""",
    "boundary_preds": """select p_partkey text_id, cast(p_size % 3 = 0 as int) prediction,
  cast(50.0 + p_size as double) confidence_score from part""",
    "test_ratings": """select * from ratings where text_id % 5 = 0""",
    "train_ratings": """select * from ratings where text_id % 5 <> 0""",
    "split_ratings": """select *, case when text_id % 5 = 0 then 'test' else 'train' end as split from ratings""",
    "eval_rows": """select r.text_id, r.annotator_id, r.y,
  case when (r.text_id * 7 + r.annotator_id * 3) % 5 = 0 then 1 - r.y else r.y end personalised,
  b.prediction boundary, b.confidence_score, a.extreme_annotator
from ratings r left join boundary_preds b on r.text_id = b.text_id
left join annotators a on r.annotator_id = a.annotator_id where r.text_id % 5 = 0""",
    "bench_cases": """select item_id case_id, case when item_id % 3 <> 0 then 'hateful' else 'non-hateful' end label_gold,
  case item_id % 4 when 0 then 'no' when 1 then '1' when 2 then 'yes' else 'no' end class_label,
  cast(60.0 + (item_id * 7) % 41 as double) confidence_score from benchmark""",
    "bench_catalog": """select distinct a.annotator_id, c.case_id,
  cast((a.annotator_id * 3 + c.case_id * 5) % 7 < 4 as int) personalised
  from (select distinct annotator_id, text_id from ratings) a join bench_cases c on c.case_id =
    (select min(case_id) from bench_cases) + a.text_id % (select max(case_id) - min(case_id) + 1 from bench_cases)""",
    "bench_fact": """select c.annotator_id, c.case_id, c.personalised, b.label_gold y, b.boundary,
  b.confidence_score, a.extreme_annotator from bench_catalog c left join
  (select case_id, case label_gold when 'hateful' then 1 when 'non-hateful' then 0 end label_gold,
    case class_label when '1' then 1 when 'yes' then 1 when 'no' then 0 end boundary, confidence_score
   from bench_cases) b on c.case_id = b.case_id
  left join annotators a on c.annotator_id = a.annotator_id""",
}

DEPENDS = {
    "ratings_raw": [],
    "ratings": ["ratings_raw"],
    "annotators": ["ratings"],
    "boundary_preds": [],
    "test_ratings": ["ratings"],
    "train_ratings": ["ratings"],
    "split_ratings": ["ratings"],
    "eval_rows": ["ratings", "boundary_preds", "annotators"],
    "bench_cases": [],
    "bench_catalog": ["ratings", "bench_cases"],
    "bench_fact": ["bench_catalog", "bench_cases", "annotators"],
}


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        for d in DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(*names: str, extra: str = "") -> str:
    """``with v1 as (...), v2 as (...)`` for the named views and their
    dependencies; ``extra`` appends more CTEs (without the leading comma)."""
    parts = [f"{n} as ({VIEWS[n]})" for n in _closure(names)]
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n" if parts else ""
