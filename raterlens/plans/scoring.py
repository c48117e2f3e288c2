"""Queries: per-annotator head scoring, logits, losses, the MLlib
majority-label classifier and per-annotator head fitting (K1-K5, A4, A5, D24)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raterlens.operators import labels as lab
from raterlens.operators import scoring as sc
from raterlens.plans.base import query
from raterlens.plans.oracle_views import with_views
from raterlens.session import cut_lineage, ensure_checkpoint_dir
from raterlens.sources import files
from raterlens.sources import fixtures as fx
from raterlens.sources.tables import read_table

DIM = 64


def _scored(spark, sf, test_only=False):
    rows, vectors = fx.vector_keys(spark, sf, fx.test_ratings(spark, sf) if test_only else fx.ratings(spark, sf))
    return sc.score_with_heads(rows, fx.head_weights(spark, sf, DIM), vectors=vectors)


def _score_ctes(rows: str) -> str:
    return f"""feat as (select r.text_id, r.annotator_id, r.y, e.embedding
  from {rows} r join embeddings e on e.vec_id = r.text_id % (select count(*) from embeddings)),
lg as (select text_id, annotator_id, y, label,
  sum(((annotator_id * 31 + label * 17 + i * 7) % 19 - 9) / 9.0::double * embedding[i]::double) logit
  from feat, (select unnest(range(1, {DIM + 1})) i) u, (values (0), (1)) l(label)
  group by text_id, annotator_id, y, label),
sc as (select text_id, annotator_id, y, max(case when label = 0 then logit end) logit_0,
  max(case when label = 1 then logit end) logit_1 from lg group by text_id, annotator_id, y)"""


_SCORED_SQL = with_views("ratings", extra=_score_ctes("ratings"))
_TEST_SCORED_SQL = with_views("test_ratings", extra=_score_ctes("test_ratings"))


@query("head_scoring", _SCORED_SQL + """select text_id::bigint text_id, annotator_id::bigint annotator_id,
  round(logit_0, 6) logit_0, round(logit_1, 6) logit_1 from sc""")
def head_scoring(spark, sf):
    """K1: each rating of both splits scored by its annotator's linear head."""
    s = _scored(spark, sf)
    return s.select("text_id", "annotator_id", F.col("logits")[0].alias("logit_0"),
                    F.col("logits")[1].alias("logit_1"))


@query("logits_argmax", _TEST_SCORED_SQL + """select text_id::bigint text_id, annotator_id::bigint annotator_id,
  (case when logit_1 > logit_0 then 1 else 0 end)::bigint predicted from sc""")
def logits_argmax(spark, sf):
    """A5/K2: predicted label = first maximal logit, on the test split."""
    s = _scored(spark, sf, test_only=True)
    return s.select("text_id", "annotator_id", sc.predicted_label("logits").alias("predicted"))


@query("attach_logits", with_views("eval_rows", "test_ratings", extra=_score_ctes("test_ratings")) + """select e.text_id::bigint text_id, e.annotator_id::bigint annotator_id, e.y::bigint y,
  e.personalised::bigint personalised, round(sc.logit_0, 6) logit_0, round(sc.logit_1, 6) logit_1
  from eval_rows e left join sc on e.text_id = sc.text_id and e.annotator_id = sc.annotator_id""")
def attach_logits(spark, sf):
    """A4: logits keyed by (text, annotator) joined to the evaluated rows."""
    s = _scored(spark, sf, test_only=True).select("text_id", "annotator_id", "logits")
    e = fx.eval_rows(spark, sf).select("text_id", "annotator_id", "y", "personalised")
    out = sc.attach_logits(e, s)
    return out.select("text_id", "annotator_id", "y", "personalised",
                      F.col("logits")[0].alias("logit_0"), F.col("logits")[1].alias("logit_1"))


@query("attach_logits_by_position", _TEST_SCORED_SQL + """select text_id::bigint text_id, annotator_id::bigint annotator_id,
  y::bigint y, round(logit_0, 6) logit_0, round(logit_1, 6) logit_1 from sc""")
def attach_logits_by_position(spark, sf):
    """A4: logits written as a matrix file in the order of the test rows, read
    back and joined to them by row position."""
    order = ["text_id", "annotator_id"]
    s = sc.with_positions(_scored(spark, sf, test_only=True).select(*order, "logits"), order)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logits-{uuid.uuid4().hex}"
    files.write_matrix(s, path, "position", "logits")
    rows = fx.test_ratings(spark, sf).select(*order, "y")
    out = sc.positional_join(rows, files.read_matrix(spark, path, "logits"), order)
    return out.select(*order, "y", F.col("logits")[0].alias("logit_0"), F.col("logits")[1].alias("logit_1"))


@query("weighted_cross_entropy", _SCORED_SQL + """, ce as (select y,
  greatest(logit_0, logit_1) + ln(exp(logit_0 - greatest(logit_0, logit_1)) + exp(logit_1 - greatest(logit_0, logit_1)))
    - case when y = 1 then logit_1 else logit_0 end ce from sc),
cw as (select y, count(*) / sum(count(*)) over () w from ce group by y)
select count(*)::bigint n_rows, round(avg(ce), 6) loss_mean, round(sum(w * ce) / sum(w), 6) loss_weighted_mean,
  round(sum(w * ce) / count(*), 6) loss_weighted_sum_per_item from ce join cw on ce.y = cw.y""")
def weighted_cross_entropy(spark, sf):
    """Cross-entropy of the head logits, plain and weighted by class
    frequency (the weighting of the studied trainer)."""
    s = _scored(spark, sf)
    w = lab.class_weights(s.select("y"), "y").select("y", "weight")
    return sc.weighted_cross_entropy(s, "y", "logits", w)


def _text_features(spark, sf, split_test: bool):
    maj = lab.majority_labels(fx.ratings(spark, sf), "text_id", "y")
    maj = maj.filter((F.col("text_id") % 5 == 0) if split_test else (F.col("text_id") % 5 != 0))
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    n = e.agg(F.count(F.lit(1))).scalar()
    return maj.withColumn("vec_id", F.col("text_id") % n).join(e, "vec_id").drop("vec_id")


def _weighted_train(spark, sf):
    train = _text_features(spark, sf, False)
    w = lab.class_weights(train, "label").select("label", F.col("weight").alias("class_weight"))
    return train.join(F.broadcast(w), "label")


# Largest gradient component at which a fit counts as optimal: of the mean loss
# (K4, whose solver stops by relative improvement) and of a head's sum (K5).
OPTIMAL_MEAN, OPTIMAL_HEAD = 1e-4, 1e-5


@query("majority_classifier_optimality", with_views("ratings", extra="""mv as (select text_id, y label from (select text_id, y,
  row_number() over (partition by text_id order by count(*) desc, y) rn from ratings group by text_id, y) q where rn = 1)""")
    + "select count(*)::bigint n_rows, true optimal from mv where text_id % 5 <> 0")
def majority_classifier_optimality(spark, sf):
    """K4: the fitted classifier's certificate: the gradient of its loss over
    all train texts, recomputed, vanishes."""
    train = cut_lineage(_weighted_train(spark, sf))
    model, _ = sc.majority_classifier(train, train, weight_col="class_weight", max_iter=500, tol=1e-12)
    c = sc.classifier_optimality(model, train, weight_col="class_weight")
    return c.select("n_rows", (F.col("gradient") <= OPTIMAL_MEAN).alias("optimal"))


def _head_rows(spark, sf):
    return fx.vector_keys(spark, sf, fx.train_ratings(spark, sf))


@query("annotator_heads_optimality", with_views("train_ratings") + """select annotator_id::bigint annotator_id,
  count(*)::bigint n_rows, true optimal from train_ratings group by annotator_id""")
def annotator_heads_optimality(spark, sf):
    """K5: each head's certificate: the gradient of its penalised likelihood
    over the annotator's rows, recomputed, vanishes."""
    rows, vectors = _head_rows(spark, sf)
    heads = sc.fit_annotator_heads(rows, DIM, vectors=vectors)
    c = sc.head_optimality(rows, heads, DIM, vectors=vectors)
    return c.select("annotator_id", "n_rows", (F.col("gradient") <= OPTIMAL_HEAD).alias("optimal"))


@query("majority_classifier")
def majority_classifier(spark, sf):
    """K4: class-weighted logistic regression of the majority label on frozen
    text features (MLlib); predictions on the test texts."""
    train = _weighted_train(spark, sf)
    _, pred = sc.majority_classifier(train, _text_features(spark, sf, True), weight_col="class_weight")
    return pred.select("text_id", "label", "prediction", "p_positive")


@query("fit_annotator_heads")
def fit_annotator_heads(spark, sf):
    """K5: one logistic head per annotator fitted on the train ratings'
    frozen features; output in the head-table form scored by K1."""
    rows, vectors = _head_rows(spark, sf)
    heads = sc.fit_annotator_heads(rows, DIM, vectors=vectors)
    return heads.select("annotator_id", F.col("weights")[1].alias("w_positive"),
                        F.col("bias")[1].alias("b_positive"), "n_rows", "steps", "converged")
