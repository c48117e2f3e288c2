"""Queries: label aggregation, balancing, weights, label maps (J11, J12,
J15, B3, B8, D3, D7, D16, F3, F4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from raterlens.config import BOUNDARY_CLASS_MAP, GOLD_LABEL_MAP
from raterlens.functions.columns import binarize, map_values, seeded_order
from raterlens.operators import labels as lab
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.plans.sqlkit import seeded_order_sql
from raterlens.sources import fixtures as fx
from raterlens.sources.tables import read_table

SEED = 11
HEAD_N = 1000

_MAJ = with_views("split_ratings", extra="""maj as (select split, text_id, text, label from (
  select split, text_id, min(comment) over (partition by split, text_id) text, y label,
    row_number() over (partition by split, text_id order by count(*) desc, y) rn
  from split_ratings group by split, text_id, comment, y) q where rn = 1)""")


def _majority(spark, sf):
    m = lab.majority_vote(fx.split_ratings(spark, sf), label="y", by=["split"])
    return m.select("split", "text_id", "text", "label")


@query("majority_vote", _MAJ + "select split, text_id::bigint text_id, text, label::bigint label from maj")
def majority_vote(spark, sf):
    """Per split and text: the text and its majority label (ties -> lowest)."""
    return _majority(spark, sf)


@query("balance_classes", _MAJ + f""", cls as (select split, label, count(*) n from maj group by split, label),
m as (select split, min(n) m from cls group by split)
select split, text_id::bigint text_id, text, label::bigint label from (
  select maj.*, m.m, row_number() over (partition by maj.split, label
    order by {seeded_order_sql('text_id', SEED)}, text_id) rn
  from maj join m on maj.split = m.split) q where rn <= m""")
def balance_classes(spark, sf):
    """Per split, every class cut to the minority size by seeded order."""
    return lab.balance_classes(_majority(spark, sf), seed=SEED, by="split").select(
        "split", "text_id", "text", "label")


@query("label_distribution", _MAJ + """select split, label::bigint label, count(*)::bigint n,
  round(count(*) / sum(count(*)) over (partition by split), 6) fraction from maj group by split, label""")
def label_distribution(spark, sf):
    """Label counts and fractions of the majority data, per split."""
    g = _majority(spark, sf).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    # the totals are sums of the few grouped counts
    total = F.sum("n").over(Window.partitionBy("split"))
    return g.select("split", "label", "n", (F.col("n") / total).alias("fraction"))


@query("class_weights", """select toxic::bigint label, count(*)::bigint n,
  round(count(*) / sum(count(*)) over (), 6) fraction, round(count(*) / sum(count(*)) over (), 6) weight
  from labels where doc_id in (select doc_id from documents) group by toxic""")
def class_weights(spark, sf):
    """Class frequency of the toxic label over labelled documents."""
    labels = read_table(spark, sf, "labels", ["doc_id", "toxic"])
    docs = read_table(spark, sf, "documents", ["doc_id"])
    d = labels.join(docs, "doc_id", "left_semi").select(F.col("toxic").alias("label"))
    return lab.class_weights(d)


@query("semi_join_texts", with_views("ratings", extra="""keep as (select text_id from ratings
  group by text_id having count(*) >= 30),
mv as (select text_id, text, label from (select text_id, min(comment) over (partition by text_id) text, y label,
  row_number() over (partition by text_id order by count(*) desc, y) rn
  from ratings group by text_id, comment, y) q where rn = 1)""") + """select text, label::bigint label from mv
  where text_id in (select text_id from keep)""")
def semi_join_texts(spark, sf):
    """Majority data restricted to the texts of another data set
    (here: texts with at least 30 ratings), id dropped."""
    r = fx.ratings(spark, sf)
    other = r.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 30)
    return lab.restrict_to_texts(lab.majority_vote(r, label="y"), other).select("text", "label")


@query("head_n", _MAJ + f"""select split, text_id::bigint text_id, text, label::bigint label from maj
  where split = 'train' order by text_id limit {HEAD_N}""")
def head_n(spark, sf):
    """first 1,000 rows of the train majority data by text id (top-n)."""
    return _majority(spark, sf).filter(F.col("split") == "train").orderBy("text_id").limit(HEAD_N)


@query("shuffle_rows", _MAJ + f"""select split, text_id::bigint text_id, text, label::bigint label,
  {seeded_order_sql('text_id', SEED)} shuffle_key from maj where split = 'train'""")
def shuffle_rows(spark, sf):
    """the train majority data in seeded random order (by the hash of the
    text id, whatever the partitioning), with the key it is ordered by."""
    m = _majority(spark, sf).filter(F.col("split") == "train").withColumn("shuffle_key", seeded_order("text_id", SEED))
    return m.orderBy("shuffle_key", "text_id")


@query("binarize_labels", with_views("ratings_raw") + """select text_id::bigint text_id,
  annotator_id::bigint annotator_id, toxic_score::bigint toxic_score,
  coalesce(cast(toxic_score >= 2 as int), 0)::bigint label from ratings_raw""")
def binarize_labels(spark, sf):
    """Score >= 2 -> 1; missing -> 0."""
    r = fx.ratings_raw(spark, sf)
    return r.select("text_id", "annotator_id", "toxic_score", binarize("toxic_score", 2).alias("label"))


@query("map_label_values", with_views("bench_cases") + """select case_id::bigint case_id, label_gold,
  (case label_gold when 'hateful' then 1 when 'non-hateful' then 0 end)::bigint gold,
  class_label, (case class_label when '1' then 1 when 'yes' then 1 when 'no' then 0 end)::bigint boundary_label
  from bench_cases""")
def map_label_values(spark, sf):
    """Dictionary maps of the benchmark labels; unmapped -> NULL."""
    c = fx.bench_cases(spark, sf)
    return c.select("case_id", "label_gold", map_values("label_gold", GOLD_LABEL_MAP).alias("gold"),
                    "class_label", map_values("class_label", BOUNDARY_CLASS_MAP).alias("boundary_label"))
