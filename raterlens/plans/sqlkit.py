"""SQL text helpers for the DuckDB oracles (direct, unoptimised forms)."""

from __future__ import annotations

from raterlens.config import ORDER_DIGITS, ORDER_KEYS, THRESHOLDS

THRESHOLD_LIST = ", ".join(f"({t})" for t in THRESHOLDS)


def report_ctes(name: str, src: str, keys: list[str], y: str, yhat: str, zero: str = "0") -> str:
    """CTE ``{name}`` with keys + accuracy, precision, recall, f1_score,
    support, n_labels of ``yhat`` against ``y`` per group of ``keys``.
    ``zero`` is the value of undefined precision/recall ('0' or 'null')."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    gb = f"group by {k}" if keys else ""
    gbl = f"group by {kc}label"
    return f"""{name}_lab as (select {kc}label, sum(t) nt, sum(p) np, sum(tp) tp from (
  select {kc}{y} label, 1 t, 0 p, case when {y} = {yhat} then 1 else 0 end tp from {src}
    where {y} is not null and {yhat} is not null
  union all select {kc}{yhat} label, 0 t, 1 p, 0 tp from {src}
    where {y} is not null and {yhat} is not null) q {gbl}),
{name} as (select {kc}sum(tp) / sum(nt) accuracy,
  avg(case when np > 0 then tp / np else {zero} end) "precision",
  avg(case when nt > 0 then tp / nt else {zero} end) recall,
  avg(2.0 * tp / (nt + np)) f1_score, sum(nt) support, count(*) n_labels from {name}_lab {gb})"""


def sweep_cte(name: str, src: str, y: str = "y") -> str:
    """Rows of ``src`` crossed with the thresholds and the combined label."""
    return f"""{name} as (select s.*, th.t confidence_threshold,
  case when s.confidence_score >= th.t and s.boundary = 1 then s.boundary else s.personalised end combined
  from {src} s cross join (values {THRESHOLD_LIST}) th(t))"""


def groups_cte(name: str, src: str) -> str:
    """Each row once in 'all' and once in its extreme / non_extreme group."""
    return f"""{name} as (select 'all' annotator_group, * from {src}
  union all select 'extreme' annotator_group, * from {src} where extreme_annotator
  union all select 'non_extreme' annotator_group, * from {src} where not extreme_annotator)"""


def seeded_order_sql(id_sql: str, seed_sql) -> str:
    """DuckDB text of ``functions.columns.seeded_order``."""
    return (f"('0x' || substr(sha256(cast({id_sql} as varchar) || '_' || cast(({seed_sql}) // {ORDER_KEYS} as varchar)), "
            f"cast({64 // ORDER_KEYS} * (({seed_sql}) % {ORDER_KEYS}) + 1 as bigint), {ORDER_DIGITS}))::bigint")


R6 = "round({0}, 6) {0}"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) {c}" for c in cols)
