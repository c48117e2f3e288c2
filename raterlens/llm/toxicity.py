"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train a linear classifier
in numpy with the non-negative risk estimator

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),

l the logistic loss and pi the class prior, the toxic share of the labelled
rows of the training fold. Where the second term falls below zero the step
goes against it, so the classifier can't call all unlabelled texts clean.

Features say that a word, or a word's beginning (4 to 8 bytes), occurs at least
once, twice or three times anywhere in the whole text. Those that are
significantly more frequent in P than in U are counted and chosen in Spark;
their weights are kept from falling below zero.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.llm.common import ascii_words, held_out
from raterlens.session import cut_lineage

MAX_POSITIVE = 4000     # bounds of the training sample (documents, the first by hash)
MAX_UNLABELLED = 8000
FEATURES = 1024         # bound of the features
MIN_DOCS, MIN_SHARE, MIN_Z = 3, 0.015, 5.0  # of P, for a feature
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3)       # occurrences
STEPS, LEARNING_RATE, L2 = 500, 0.05, 1e-4
THRESHOLD = 0.7
DEFAULT_PRIOR = 0.1     # where nothing is labelled
SEED = 23
CACHE_WORDS = 400_000


def word_features(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


def text_features(text: str | None) -> list[tuple[bytes, int]]:
    """(feature, level) pairs of a whole text."""
    counts: Counter = Counter()
    for w, k in Counter(ascii_words(text)).items():
        for f in word_features(w):
            counts[f] += k
    return [(f, n) for f, k in counts.items() for n in LEVELS if k >= n]


def nnpu_fit(x_pos: np.ndarray, x_un: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk."""
    d = x_pos.shape[1]
    theta = np.zeros(d + 1, np.float32)
    theta[d] = np.log(prior / (1 - prior))
    if not len(x_pos) or not len(x_un):
        return theta[:d], float(theta[d])
    m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def mean_grad(x, dl):
        return np.append(x.T @ dl, dl.sum()) / len(x)

    for step in range(1, STEPS + 1):
        gp, gu = x_pos @ theta[:d] + theta[d], x_un @ theta[:d] + theta[d]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        g_neg = mean_grad(x_un, sig(gu)) - prior * mean_grad(x_pos, sig(gp))
        g = prior * mean_grad(x_pos, sig(gp) - 1) + g_neg if negative >= 0 else -g_neg
        g[:d] += L2 * theta[:d]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        theta -= LEARNING_RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(theta[:d], 0, out=theta[:d])  # the features are signs of P
    return theta[:d].astype(float), float(theta[d])


def _feature_counts(batches):
    """Documents with each feature, counted within the task, in P and in U."""
    schema = pa.schema([("feature", pa.binary()), ("level", pa.int32()), ("p", pa.int64()), ("u", pa.int64())])
    counts = {True: Counter(), False: Counter()}

    def flush():
        keys = list(counts[True].keys() | counts[False].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in keys], pa.binary()), pa.array([n for _, n in keys], pa.int32()),
             *(pa.array([counts[c][k] for k in keys], pa.int64()) for c in (True, False))],
            schema=schema)
        counts[True].clear()
        counts[False].clear()
        return out

    for batch in batches:
        for positive, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts[positive].update(text_features(text))
            if len(counts[positive]) > CACHE_WORDS:
                yield flush()
    yield flush()


def _doc_vectors(vocabulary):
    schema = pa.schema([("positive", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        index = {f: i for i, f in enumerate(vocabulary)}
        for batch in batches:
            pos, at = [], []
            for positive, text in zip(*(c.to_pylist() for c in batch.columns)):
                pos.append(positive)
                at.append(sorted(index[f] for f in text_features(text) if f in index))
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.bool_()), pa.array(at, pa.list_(pa.int32()))], schema=schema)

    return run


def _first(ids: DataFrame, n: int) -> DataFrame:
    """The first n ids by hash (a bounded top-n, cut in every task)."""
    return ids.distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on rows outside the held-out fold (crc32 of the id mod 3 is not 1).

    ``labels`` needs doc_id and toxic. At most MAX_POSITIVE confirmed toxic
    and MAX_UNLABELLED other documents of the fold (labels hidden) are read;
    at most FEATURES features and the sample's indices of them reach the
    driver. Counts of features are taken in Spark. Without positives or
    features the model is the prior alone.
    """
    fold = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id", 3, 1)) \
        .groupBy("id").agg(F.max("toxic").alias("toxic"))  # one label an id: toxic if any of its labels says so
    seen = fold.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    prior = DEFAULT_PRIOR if seen is None else min(0.9, max(0.001, seen))
    positive = _first(fold.filter("toxic = 1").select("id"), MAX_POSITIVE).withColumn("positive", F.lit(True))
    unlabelled = _first(docs.select(F.col("doc_id").cast("bigint").alias("id"))
                        .filter(F.col("id").isNotNull() & ~held_out("id", 3, 1)), MAX_UNLABELLED) \
        .withColumn("positive", F.lit(False))
    # at most MAX_POSITIVE + MAX_UNLABELLED rows of two small columns
    chosen = F.broadcast(positive.union(unlabelled))
    texts = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
        .join(chosen, "id").select("positive", "text")
        .dropDuplicates(["positive", "text"]))  # copies would make their words look significant
    sizes = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    model = {"features": [], "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior))), "prior": prior}
    if not n_p or not n_u:
        return model
    counts = texts.mapInArrow(_feature_counts, "feature binary, level int, p bigint, u bigint").groupBy("feature", "level").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + F.lit(1e-12))
    top = (counts.filter(F.col("p") >= max(MIN_DOCS, MIN_SHARE * n_p)).withColumn("z", z).filter(F.col("z") >= MIN_Z)
           .orderBy(F.desc("z"), "feature", "level").limit(FEATURES).select("feature", "level").collect())
    features = [(bytes(r["feature"]), r["level"]) for r in top]
    if not features:
        return model
    rows = texts.mapInArrow(_doc_vectors(features), "positive boolean, at array<int>").toPandas()
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, at in enumerate(rows["at"]):
        x[i, np.asarray(at, np.int64)] = 1
    is_p = rows["positive"].to_numpy(bool)
    weights, bias = nnpu_fit(x[is_p], x[~is_p], prior)
    return model | {"features": features, "weights": weights, "bias": bias}


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(model):
    def run(batches):
        weights: dict[bytes, list[tuple[int, float]]] = {}
        for (f, n), w in zip(model.value["features"], model.value["weights"].tolist()):
            weights.setdefault(f, []).append((n, w))
        bias = model.value["bias"]
        known: dict[bytes, tuple] = {}  # features of words that the model has
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                if len(known) > CACHE_WORDS:
                    known.clear()
                counts: dict[bytes, int] = {}
                for w in ascii_words(text.as_py()):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(f for f in word_features(w) if f in weights)
                    for f in found:
                        counts[f] = counts.get(f, 0) + 1
                scores[i] = bias + sum(w for f in sorted(counts) for n, w in weights[f] if counts[f] >= n)
            scores = 1 / (1 + np.exp(-np.clip(scores, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores),
                 pa.array((scores >= THRESHOLD).astype(np.int32))], schema=_OUT)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """Toxicity of every whole text.

    ``docs`` needs doc_id and text; further columns are ignored. Pass
    ``labels`` to train or a trained ``model``. Returns a row for every input
    row: doc_id, held_out (crc32 of the id as text mod 3 is 1), score (0 to 1)
    and predicted (1 if score >= 0.7, else 0).

    Null and empty texts get the score of a text without features. Null ids
    are not held out and not learnt from; repeated rows and repeated labels
    count once by id; null labels are no labels; an empty table gives no rows.
    All words of a very long text count; their list costs its task about ten
    times the text.
    """
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id bigint, held_out boolean, score double, predicted int")
