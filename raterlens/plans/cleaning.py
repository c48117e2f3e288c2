"""Queries: cleaning, keys and identifier audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from raterlens.functions.columns import composite_key
from raterlens.operators import clean
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.session import cut_lineage
from raterlens.sources import fixtures as fx

_J1_SQL = with_views("ratings_raw", extra="""ids as (
  select comment, row_number() over (order by comment) - 1 as text_id
  from (select distinct comment from ratings_raw where comment is not null) d),
keyed as (
  select r.comment, r.comment_id, r.source, r.worker_id, r.toxic_score, i.text_id,
    cast(i.text_id as varchar) || '_' || r.worker_id as annotation_id,
    count(*) over (partition by cast(i.text_id as varchar) || '_' || r.worker_id) as n_key
  from ratings_raw r left join ids i on r.comment is not distinct from i.comment)""")


@query("clean_ratings", _J1_SQL + """select comment, comment_id::bigint comment_id, source, worker_id,
  toxic_score::bigint toxic_score, text_id::bigint text_id, annotation_id from keyed where n_key = 1""")
def clean_ratings(spark, sf):
    """Dense text ids, annotation ids, every repeated annotation dropped."""
    kept, _ = clean.clean_ratings(fx.ratings_raw(spark, sf).drop("annotator_id"))
    return kept


@query("clean_ratings_dropped", _J1_SQL + """select comment, comment_id::bigint comment_id, source, worker_id,
  toxic_score::bigint toxic_score, text_id::bigint text_id, annotation_id from keyed where n_key > 1""")
def clean_ratings_dropped(spark, sf):
    """J1 second output: the dropped rows (all copies of a repeated annotation)."""
    _, dropped = clean.clean_ratings(fx.ratings_raw(spark, sf).drop("annotator_id"))
    return dropped

_RAW = with_views("ratings_raw")


@query("composite_keys", _RAW + """select comment_id::bigint comment_id, source, worker_id,
  cast(comment_id as varchar) || '_' || source as instance_id,
  cast(comment_id as varchar) || '_' || source || '_' || worker_id as sample_id from ratings_raw""")
def composite_keys(spark, sf):
    """B2: string keys; a NULL part gives a NULL key."""
    r = fx.ratings_raw(spark, sf)
    return r.select("comment_id", "source", "worker_id",
                    composite_key("comment_id", "source").alias("instance_id"),
                    composite_key("comment_id", "source", "worker_id").alias("sample_id"))


@query("assign_text_ids", _RAW + """select comment, (row_number() over (order by comment) - 1)::bigint text_id
  from (select distinct comment from ratings_raw where comment is not null) d""")
def assign_text_ids(spark, sf):
    """Dense text id per distinct comment, ascending comment order."""
    return clean.dense_ids(fx.ratings_raw(spark, sf), "comment", "text_id")


@query("conflicting_comment_ids", _RAW + """select comment_id::bigint comment_id, source,
  count(distinct comment)::bigint n_comments from ratings_raw group by comment_id, source
  having count(distinct comment) > 1""")
def conflicting_comment_ids(spark, sf):
    """(comment_id, source) keys with more than one text."""
    return clean.conflicting_comment_ids(fx.ratings_raw(spark, sf))


@query("comments_multiple_source", _RAW + """select comment_id::bigint comment_id,
  count(distinct source)::bigint n_sources, count(distinct comment)::bigint n_comments
  from ratings_raw group by comment_id having count(distinct source) > 1 order by n_sources desc, comment_id""")
def comments_multiple_source(spark, sf):
    """Comment ids seen with several sources (sorted, id breaks ties)."""
    r = fx.ratings_raw(spark, sf)
    return (r.groupBy("comment_id").agg(F.countDistinct("source").alias("n_sources"),
                                        F.countDistinct("comment").alias("n_comments"))
            .filter(F.col("n_sources") > 1).orderBy(F.col("n_sources").desc(), "comment_id"))


@query("comment_id_unique_source", _RAW + """select bool_and(n = 1) all_single_source,
  count(*)::bigint n_comment_ids, count(*) filter (where n > 1)::bigint n_multi_source
  from (select comment_id, count(distinct source) n from ratings_raw group by comment_id) q""")
def comment_id_unique_source(spark, sf):
    """Does every comment id have a single source?"""
    per = fx.ratings_raw(spark, sf).groupBy("comment_id").agg(F.countDistinct("source").alias("n"))
    return per.agg(F.bool_and(F.col("n") == 1).alias("all_single_source"),
                   F.count(F.lit(1)).alias("n_comment_ids"),
                   F.count_if(F.col("n") > 1).alias("n_multi_source"))


_SAMPLE = "cast(comment_id as varchar) || '_' || source || '_' || worker_id"


@query("duplicate_annotations", _RAW + f"""select comment, comment_id::bigint comment_id, source, worker_id,
  toxic_score::bigint toxic_score, sample_id from (select *, {_SAMPLE} sample_id,
  count(*) over (partition by {_SAMPLE}) n from ratings_raw) q where n > 1""")
def duplicate_annotations(spark, sf):
    """Every row of a sample id that occurs more than once."""
    r = fx.ratings_raw(spark, sf).withColumn("sample_id", composite_key("comment_id", "source", "worker_id"))
    return clean.rows_of_repeated_keys(r, ["sample_id"]).select(
        "comment", "comment_id", "source", "worker_id", "toxic_score", "sample_id")


_J2_SQL = with_views("ratings_raw", extra=f"""k as (select *, {_SAMPLE} sample_id from ratings_raw),
bad as (select comment_id, source from k group by comment_id, source having count(distinct comment) > 1),
s1 as (select distinct sample_id from k join bad using (comment_id, source)),
r1 as (select * from k where sample_id not in (select sample_id from s1)),
s3 as (select sample_id from r1 group by sample_id having count(*) > 1),
dropped as (select sample_id from s1 union select sample_id from s3)""")


@query("clean_ratings_by_conflict", _J2_SQL + """select comment, comment_id::bigint comment_id, source,
  worker_id, toxic_score::bigint toxic_score, sample_id from r1 where sample_id not in (select sample_id from s3)""")
def clean_ratings_by_conflict(spark, sf):
    """Rows left after the conflict-based cleaning."""
    kept, _ = clean.clean_by_conflict(fx.ratings_raw(spark, sf))
    return kept.select("comment", "comment_id", "source", "worker_id", "toxic_score", "sample_id")


@query("anti_join_dropped", _J2_SQL + """select comment, comment_id::bigint comment_id, source, worker_id,
  toxic_score::bigint toxic_score from k where sample_id not in (select sample_id from dropped)""")
def anti_join_dropped(spark, sf):
    """Raw rows minus the saved list of dropped sample ids (anti join)."""
    raw = fx.ratings_raw(spark, sf)
    _, dropped = clean.clean_by_conflict(raw)
    dropped = cut_lineage(dropped)  # the list is saved and read back
    keyed = raw.withColumn("sample_id", composite_key("comment_id", "source", "worker_id"))
    return keyed.join(dropped, "sample_id", "left_anti").select(
        "comment", "comment_id", "source", "worker_id", "toxic_score")


@query("distinct_comment_sources", _RAW + """select distinct comment_id::bigint comment_id, source, comment
  from ratings_raw where comment_id in (select comment_id from ratings_raw group by comment_id
  having count(distinct source) > 1)""")
def distinct_comment_sources(spark, sf):
    """Distinct (comment_id, source, comment) of multi-source comment ids."""
    r = fx.ratings_raw(spark, sf)
    multi = r.groupBy("comment_id").agg(F.countDistinct("source").alias("n")).filter(F.col("n") > 1)
    return r.join(multi.select("comment_id"), "comment_id", "left_semi").select(
        "comment_id", "source", "comment").distinct()


@query("duplicate_rows_check", _RAW + """select coalesce(bool_or(n > 1), false) has_duplicate_rows,
  count(*) filter (where n > 1)::bigint n_duplicated_rows from (select comment, comment_id, source, worker_id,
  toxic_score, text_id, annotator_id, count(*) n from ratings_raw
  group by comment, comment_id, source, worker_id, toxic_score, text_id, annotator_id) q""")
def duplicate_rows_check(spark, sf):
    """Is any full row repeated? (and how many distinct rows repeat)."""
    r = fx.ratings_raw(spark, sf)
    g = r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("has_duplicate_rows"),
                 F.count_if(F.col("n") > 1).alias("n_duplicated_rows"))


_AUDIT_COLS = ("text_id", "annotator_id", "y", "personalised", "boundary", "confidence_score", "extreme_annotator")


@query("null_audit", with_views("eval_rows") + " union all ".join(
    f"""select '{c}' column_name, count(*) filter (where {c} is null{" or isnan(" + c + ")" if c == "confidence_score" else ""})::bigint
  n_missing, count(*) filter (where {c} is null{" or isnan(" + c + ")" if c == "confidence_score" else ""}) > 0 has_missing
  from eval_rows""" for c in _AUDIT_COLS))
def null_audit(spark, sf):
    """Missing values per column of the evaluation fact."""
    return clean.null_audit(fx.eval_rows(spark, sf), _AUDIT_COLS)
