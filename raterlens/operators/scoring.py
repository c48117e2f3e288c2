"""Model-side data jobs on frozen text features.

Fine-tuning the encoder is out of scope; what remains are the data
contracts around it: score each row with its annotator's linear head, turn
logits into labels and losses, train a majority-label classifier with MLlib,
and fit one head per annotator.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.functions.columns import argmax, dot, log_sum_exp
from raterlens.session import cut_lineage


def score_with_heads(features: DataFrame, heads: DataFrame, annotator: str = "annotator_id",
                     features_col: str = "embedding", out: str = "logits", vectors: DataFrame | None = None,
                     key: str = "vec_id") -> DataFrame:
    """K1: ``logits[label] = W[annotator][label] . x + b[annotator][label]``.

    Equi-join on the annotator: the head table grows with the number of
    annotators (labels x dim doubles each), which the planner's estimate of an
    array column doesn't show, so it is joined by merge, never broadcast; AQE
    splits a hot annotator's partition. With ``vectors`` (key, features) the
    rows hold the key alone: they are shuffled without features, which are
    looked up beside the heads. The dot products are built-in array lambdas."""
    x = F.col(features_col)
    j = features.join(heads.hint("merge"), annotator)
    if vectors is not None:
        j = j.join(vectors, key)
    logits = F.transform(F.col("weights"), lambda w, i: dot(w, x) + F.col("bias")[i])
    return j.withColumn(out, logits).drop("weights", "bias")


def predicted_label(logits: str = "logits"):
    """K2/A5: index of the first maximal logit (numpy argmax)."""
    return argmax(logits)


def attach_logits(rows: DataFrame, logits: DataFrame, keys: Sequence[str] = ("text_id", "annotator_id"),
                  logits_col: str = "logits") -> DataFrame:
    """A4: key the prediction table by (text, annotator) instead of row
    position and left-join it; a key repeated in the predictions fails the job
    (it would fan the rows out)."""
    keys = list(keys)
    dup = (logits.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
           .agg(F.coalesce(F.max("__n"), F.lit(0)))).scalar()
    guard = F.assert_true(dup <= 1, F.lit("attach_logits: repeated prediction key"))
    lg = logits.select(*keys, F.coalesce(guard.cast("array<double>"), F.col(logits_col)).alias(logits_col))
    return rows.join(lg, keys, "left")


def with_positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``position`` of each row from 0 in the order of the columns ``order``
    (which identify a row): rows are numbered within range partitions and
    shifted by the sizes of the partitions before (one row a partition)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(rows.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    sizes = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__off"))
    number = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return (d.withColumn("__rn", number).join(F.broadcast(offsets), "__pid")
            .withColumn("position", (F.col("__off") + F.col("__rn") - 1).cast("bigint")).drop("__pid", "__rn", "__off"))


def positional_join(rows: DataFrame, matrix: DataFrame, order: Sequence[str]) -> DataFrame:
    """A4: rows in the order of ``order`` joined to a matrix by row position;
    fails if the two differ in length."""
    placed = with_positions(rows, order)
    n, m = (d.agg(F.count(F.lit(1))).scalar() for d in (placed, matrix))
    same = F.assert_true(n == m, F.lit("positional_join: rows and matrix differ in length"))
    return placed.join(matrix, "position").filter(same.isNull())


def cross_entropy(logits: str = "logits", label: str = "label"):
    """Per-row cross-entropy of the softmax of ``logits`` at ``label``
    (stable log-sum-exp)."""
    return log_sum_exp(logits) - F.col(logits)[F.col(label).cast("int")]


def weighted_cross_entropy(scored: DataFrame, label: str = "label", logits: str = "logits",
                           class_weights: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-entropy per group: plain mean, class-weighted mean
    ``sum(w*ce)/sum(w)`` and ``sum(w*ce)/n`` (sum reduction over the number of
    items). ``class_weights`` (label, weight) has one row per class, so its
    broadcast is bounded by the label count; without it every weight is 1."""
    d = scored.withColumn("__ce", cross_entropy(logits, label))
    if class_weights is not None:
        d = d.join(F.broadcast(class_weights.select(F.col(class_weights.columns[0]).alias(label),
                                                    F.col("weight").alias("__w"))), label, "left")
        w = F.coalesce(F.col("__w"), F.lit(0.0))
    else:
        w = F.lit(1.0)
    g = d.groupBy(*keys) if keys else d
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("__ce").alias("loss_mean"),
                 (F.sum(w * F.col("__ce")) / F.sum(w)).alias("loss_weighted_mean"),
                 (F.sum(w * F.col("__ce")) / F.count(F.lit(1))).alias("loss_weighted_sum_per_item"))


def majority_classifier(train: DataFrame, test: DataFrame, features_col: str = "embedding",
                        label: str = "label", weight_col: str | None = None, max_iter: int = 50,
                        reg_param: float = 0.0, tol: float = 1e-6):
    """K4: logistic regression (MLlib, distributed tree aggregation) of the
    majority label on frozen text features, optionally class-weighted.
    Returns (model, test predictions with ``prediction`` and ``p_positive``)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def prep(df):
        return df.withColumn("__features", array_to_vector(F.col(features_col).cast("array<double>")))

    lr = LogisticRegression(featuresCol="__features", labelCol=label, maxIter=max_iter, regParam=reg_param, tol=tol,
                            standardization=False, **({"weightCol": weight_col} if weight_col else {}))
    model = lr.fit(prep(train))
    pred = model.transform(prep(test))
    return model, pred.select(*[c for c in test.columns if c != features_col],
                              F.col("prediction").cast("int").alias("prediction"),
                              vector_to_array("probability")[1].alias("p_positive"))


def _gradient(rows: DataFrame, weights: Sequence, bias, features_col: str, label: str, factor=None) -> list:
    """Gradient sums (one a weight, the bias last) of the logistic log-likelihood."""
    x = F.col(features_col)
    score = bias
    for i, w in enumerate(weights):
        score = score + w * x[i]
    residual = (F.col(label) - 1 / (1 + F.exp(-score))) * (F.lit(1.0) if factor is None else factor)
    return [F.sum(residual * x[i]) for i in range(len(weights))] + [F.sum(residual)]


def classifier_optimality(model, train: DataFrame, features_col: str = "embedding", label: str = "label",
                          weight_col: str | None = None) -> DataFrame:
    """K4: a certificate of the fitted weights, one row: n_rows and the largest
    component of the mean weighted gradient (0 at the optimum of the convex,
    unregularised loss)."""
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    sums = _gradient(train, [F.lit(float(c)) for c in model.coefficients], F.lit(float(model.intercept)),
                     features_col, label, w)
    return train.agg(F.count(F.lit(1)).alias("n_rows"), (F.greatest(*[F.abs(s) for s in sums]) / F.sum(w)).alias("gradient"))


def head_optimality(rows: DataFrame, heads: DataFrame, dim: int, annotator: str = "annotator_id",
                    features_col: str = "embedding", label: str = "y", l2: float = 1.0,
                    vectors: DataFrame | None = None, key: str = "vec_id", group_rows: int | None = None) -> DataFrame:
    """K5: a certificate of each head: n_rows and the largest component of the
    gradient of its penalised likelihood, recomputed from the rows (0 at the
    optimum, which is unique).

    With ``vectors`` (key, features) the rows hold the key alone. They are dealt
    by annotator (of more than ``group_rows`` rows: by parts of one), and a task
    gets each head and each vector of its rows once, so neither travels with the
    rows. A task sums its annotators' gradients; only those of parts are summed
    again behind it."""
    if vectors is not None:
        return _dealt_optimality(rows, heads, dim, annotator, features_col, label, l2, vectors, key,
                                 group_rows or HEAD_GROUP_ROWS)
    w = heads.select(annotator, F.transform("weights", lambda v: v)[1].alias("__w"), F.col("bias")[1].alias("__b"))
    half = [2 * F.col("__w")[i] for i in range(dim)]  # label 1 holds half of the binary head
    sums = _gradient(rows, half, 2 * F.col("__b"), features_col, label)
    each = rows.join(w.hint("merge"), annotator).groupBy(annotator).agg(
        F.count(F.lit(1)).alias("n_rows"), F.first("__w").alias("__w"), F.first("__b").alias("__b"),
        *[s.alias(f"__g{i}") for i, s in enumerate(sums)])
    parts = [F.abs(F.col(f"__g{i}") - 2 * l2 * (F.col("__w")[i] if i < dim else F.col("__b"))) for i in range(dim + 1)]
    return each.select(annotator, "n_rows", F.greatest(*parts).alias("gradient"))


_GRADIENT_SCHEMA = "annotator_id bigint, n_rows bigint, gradient double, sums array<double>, w array<double>"
_GRADIENTS = pa.schema([("annotator_id", pa.int64()), ("n_rows", pa.int64()), ("gradient", pa.float64()),
                        ("sums", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])


def _dealt_optimality(rows, heads, dim, annotator, features_col, label, l2, vectors, key, group_rows) -> DataFrame:
    data = rows.select(F.col(annotator).cast("bigint").alias("annotator_id"), F.col(key).alias("x"),
                       F.col(label).cast("double").alias("y")).dropna(subset=["annotator_id", "x"])
    twice = F.transform(F.concat(F.col("weights")[1], F.array(F.col("bias")[1])), lambda v: 2 * v)
    held = heads.select(F.col(annotator).cast("bigint").alias("annotator_id"), twice.alias("w"))
    sizes = (heads.select(F.col(annotator).cast("bigint").alias("annotator_id"), "n_rows") if "n_rows" in heads.columns
             else data.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_rows")))
    several = cut_lineage(sizes.filter(F.col("n_rows") > group_rows).groupBy("annotator_id").agg(
        F.ceil(F.max("n_rows") / F.lit(group_rows)).cast("bigint").alias("parts")))
    tasks = _head_tasks(data, vectors, dim)
    split = not several.isEmpty()

    def deal(part):
        return F.pmod(F.xxhash64("annotator_id", part), F.lit(tasks))

    first = F.lit(0).cast("bigint")
    if split:  # a row's part is drawn once
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
        data = cut_lineage(data.join(several, "annotator_id", "left").withColumn("part", part).select(
            "annotator_id", "x", "y", deal(F.col("part")).alias("deal")))
        every = F.sequence(first, F.coalesce("parts", F.lit(1)) - 1)
        held = held.join(several, "annotator_id", "left").select(
            "annotator_id", "w", F.coalesce(F.col("parts") > 1, F.lit(False)).alias("split"),
            F.explode(F.array_distinct(F.transform(every, deal))).alias("deal"))
    else:
        data = data.withColumn("deal", deal(first))
        held = held.select("annotator_id", "w", F.lit(False).alias("split"), deal(first).alias("deal"))

    def whole(array):  # one that holds a null gives no gradient
        return F.when(~F.exists(array, lambda v: v.isNull()), F.col(array)).alias(array)

    side = _vectors_of(data, vectors, key, features_col).select("deal", "key", whole("vector")).unionByName(
        held.select("deal", F.col("annotator_id").alias("head"), whole("w"), "split"), allowMissingColumns=True)
    found = _cogroup(data, side, tasks).applyInArrow(_sum_gradients(dim, l2), _GRADIENT_SCHEMA)
    if split:
        found = cut_lineage(found)
        parts = [F.abs(F.sum(F.col("sums")[i]) - l2 * F.first("w")[i]) for i in range(dim + 1)]
        summed = found.filter("w IS NOT NULL").groupBy("annotator_id").agg(
            F.sum("n_rows").alias("n_rows"), F.greatest(*parts).alias("gradient"))
        found = found.filter("w IS NULL").select("annotator_id", "n_rows", "gradient").unionByName(summed)
    return found.select(F.col("annotator_id").alias(annotator), "n_rows", "gradient")


def _sum_gradients(dim: int, l2: float):
    """Gradients of a task's annotators: of a whole one the largest component,
    of one in parts the sums and the head."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        heads = side.filter(pc.is_valid(side["head"]))
        vectors = side.filter(pc.is_valid(side["key"]))
        row, at = _matches(vectors["key"], rows["x"])
        mine, head = _matches(heads["head"], rows["annotator_id"].take(pa.array(row)))
        row, at = row[mine], at[mine]
        v, has_v = _matrix(vectors["vector"], dim)
        w, has_w = _matrix(heads["w"], dim + 1)
        ids, y = rows["annotator_id"].to_numpy()[row], rows["y"].to_numpy()[row]
        real = has_v[at] & has_w[head] & rows["y"].is_valid().to_numpy()[row]
        order = np.argsort(ids, kind="stable")
        found, starts, counts = np.unique(ids[order], return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(found)), counts)
        sums, used = np.zeros((len(found), dim + 1)), np.zeros(len(found), np.int64)
        for lo in range(0, len(order), HEAD_CHUNK_ROWS):
            some = order[lo:lo + HEAD_CHUNK_ROWS]
            to = place[lo:lo + HEAD_CHUNK_ROWS][real[some]]
            some = some[real[some]]
            if not len(some):
                continue
            x, theta = v[at[some]].astype(float), w[head[some]]
            x = np.hstack([x, np.ones((len(x), 1))])
            with np.errstate(over="ignore"):
                residual = y[some] - 1.0 / (1.0 + np.exp(-np.einsum("ij,ij->i", x, theta)))
            whose, border = np.unique(to, return_index=True)
            sums[whose] += np.add.reduceat(x * residual[:, None], border, axis=0)
            used[whose] += np.diff([*border, len(to)])
        own, none = head[order[starts]], used == 0
        theta, parts = w[own], np.array(heads["split"].to_pylist(), bool)[own]
        gradient = np.abs(sums - l2 * theta).max(axis=1)
        return pa.table([pa.array(found, pa.int64()), pa.array(counts, pa.int64()),
                         pa.array(gradient, pa.float64(), mask=none | parts),
                         pa.array([s if p and not n else None for s, p, n in zip(sums, parts, none)], _GRADIENTS[3].type),
                         pa.array([t if p else None for t, p in zip(theta, parts)], _GRADIENTS[4].type)], schema=_GRADIENTS)

    return run


# --- per-annotator heads (K5) -----------------------------------------------

# Rows of one annotator handled in one group; more are split into parts of this size.
HEAD_GROUP_ROWS = 4096
HEAD_TASK_ROWS = 64 * HEAD_GROUP_ROWS  # rows a task holds with their vectors
HEAD_TASK_NUMBERS = 1 << 24  # where all vectors are of so few numbers, a task holds more rows
HEAD_CHUNK_ROWS = 4 * HEAD_GROUP_ROWS  # rows whose vectors are taken in double precision at once
HEADS_AT_ONCE = 256     # fits stepped together, one Hessian each
HEAD_TOLERANCE = 1e-8   # largest change of a weight at which a fit has converged
HEAD_MAX_STEPS = 100    # a fit that has not converged by then says so

_STATS_SCHEMA = "annotator_id bigint, grad array<double>, hess array<double>, w array<double>, n bigint"
_HEAD_SCHEMA = "annotator_id bigint, w array<double>, n_rows bigint, steps int, converged boolean"
_HEADS = pa.schema([("annotator_id", pa.int64()), ("w", pa.list_(pa.float64())), ("n_rows", pa.int64()),
                    ("steps", pa.int32()), ("converged", pa.bool_())])


def _head_tasks(rows: DataFrame, vectors: DataFrame, dim: int) -> int:
    """Tasks over which annotators are dealt: the larger they are, the fewer
    copies of a vector are moved."""
    size = HEAD_TASK_ROWS * (4 if vectors.count() * dim <= HEAD_TASK_NUMBERS else 1)
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size))


def _vectors_of(dealt: DataFrame, vectors: DataFrame, key: str, features_col: str) -> DataFrame:
    """(deal, key, vector): the vectors of each deal's rows, each once a deal
    (a repeated key has all of its vectors)."""
    found = vectors.select(F.col(key).alias("key"), F.col(features_col).alias("vector"))
    needed = dealt.select(F.col("deal").alias("deal"), F.col("x").alias("key")).distinct()
    return needed.join(found, "key")


def _cogroup(rows: DataFrame, side: DataFrame, tasks: int):
    rows, side = (d.repartition(2 * tasks, "deal").groupBy("deal") for d in (rows, side))  # few deals share a task
    return rows.cogroup(side)


def _matches(keys, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an inner join, in the order of ``wanted``: positions in
    ``wanted`` and in ``keys``."""
    keys, wanted = keys.to_numpy(), wanted.to_numpy()
    order = np.argsort(keys, kind="stable")
    lo, hi = (np.searchsorted(keys[order], wanted, side) for side in ("left", "right"))
    row = np.repeat(np.arange(len(wanted)), hi - lo)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]


def _matrix(lists, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` numbers of every list, and whether there is one."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    has = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = set(pc.unique(pc.list_value_length(lists.drop_null())).to_pylist())
    if len(sizes) > 1 or sizes and min(sizes) < width:
        raise ValueError(f"head_optimality: features of lengths {sizes}, {width} expected")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(has), width), flat.dtype if len(flat) else float)
    if len(flat):
        out[has] = flat.reshape(-1, *sizes)[:, :width]
    return out, has


def _design(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["x"].to_numpy()).astype(float)
    return np.hstack([x, np.ones((len(x), 1))])


def _statistics(x, y, w):
    """Gradient and Hessian of the logistic log-likelihood (bias as last weight)."""
    p = 1.0 / (1.0 + np.exp(-(x @ w)))
    return x.T @ (y - p), (x * (p * (1.0 - p))[:, None]).T @ x


def _step(g, h, w, l2):
    return np.linalg.solve(h + l2 * np.eye(len(w)), g - l2 * w)


def _newton(x: np.ndarray, y: np.ndarray, real: np.ndarray, l2: float):
    """Fits of several annotators at once: weights, steps, converged. ``x`` is
    (annotator, row, weight); ``real`` is 0 for rows that only fill up."""
    count, _, size = x.shape
    w, steps, moved = np.zeros((count, size)), np.zeros(count, int), np.full(count, np.inf)
    ridge = l2 * np.eye(size)
    moving = np.arange(count)
    while len(moving):
        a, v = x[moving], w[moving]
        p = 1.0 / (1.0 + np.exp(-(a @ v[:, :, None])[:, :, 0]))
        at = a.transpose(0, 2, 1)
        g = (at @ ((y[moving] - p) * real[moving])[:, :, None])[:, :, 0]
        h = at @ (a * (p * (1.0 - p) * real[moving])[:, :, None])
        d = np.linalg.solve(h + ridge, (g - l2 * v)[:, :, None])[:, :, 0]
        w[moving], moved[moving] = v + d, np.abs(d).max(axis=1)
        steps[moving] += 1
        moving = moving[(moved[moving] > HEAD_TOLERANCE) & (steps[moving] < HEAD_MAX_STEPS)]
    return w, steps, moved <= HEAD_TOLERANCE


def _fit_group(l2: float):
    """All Newton steps of the annotators of a group, those of like row
    numbers together."""

    def fit(table: pa.Table) -> pa.Table:
        vectors = table["x"].combine_chunks()
        sizes = set(pc.unique(pc.list_value_length(vectors)).to_pylist())
        if len(sizes) != 1 or None in sizes:
            raise ValueError(f"fit_annotator_heads: features of lengths {sizes}")
        ids, y = table["annotator_id"].to_numpy(), table["y"].to_numpy()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        x = np.hstack([x, np.ones((len(x), 1))])
        order = np.argsort(ids, kind="stable")
        found, starts, counts = np.unique(ids[order], return_index=True, return_counts=True)
        out = []
        like = np.ceil(np.log2(counts)).astype(int)  # filled up to at most twice the rows
        for kind in np.unique(like):
            same = np.flatnonzero(like == kind)
            for some in np.array_split(same, -(-len(same) // HEADS_AT_ONCE)):
                place = np.arange(counts[some].max())
                real = place < counts[some][:, None]
                rows = order[starts[some][:, None] + np.where(real, place, 0)]
                w, steps, converged = _newton(x[rows], y[rows], real.astype(float), l2)
                out += zip(found[some].tolist(), w.tolist(), counts[some].tolist(), steps.tolist(), converged.tolist())
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _HEADS)], schema=_HEADS)

    return fit


def _fit_looked_up(fit):
    """``fit`` for a task's rows that hold the keys of their vectors: whole
    annotators at once, about HEAD_CHUNK_ROWS rows."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        row, at = _matches(side["key"], rows["x"])
        ids, vectors = rows["annotator_id"].to_numpy()[row], side["vector"].combine_chunks()
        order = np.argsort(ids, kind="stable")
        starts = np.unique(ids[order], return_index=True)[1]
        cuts = np.flatnonzero(np.diff(starts // HEAD_CHUNK_ROWS, prepend=-1))
        out = [_HEADS.empty_table()]
        for some in np.split(order, starts[cuts[1:]]) if len(order) else []:
            part = rows.take(pa.array(row[some]))
            out.append(fit(pa.table({"annotator_id": part["annotator_id"], "x": vectors.take(pa.array(at[some])),
                                     "y": part["y"]})))
        return pa.concat_tables(out)

    return run


def _part_statistics(key, pdf):
    w = np.asarray(pdf["w"].iloc[0], dtype=float)
    g, h = _statistics(_design(pdf), pdf["y"].to_numpy(dtype=float), w)
    return pd.DataFrame({"annotator_id": [int(key[0])], "grad": [g.tolist()], "hess": [h.ravel().tolist()],
                         "w": [w.tolist()], "n": [len(pdf)]})


def _combine_parts(l2: float, steps: int):
    def combine(key, pdf):
        w = np.asarray(pdf["w"].iloc[0], dtype=float)
        g = np.sum(np.stack(pdf["grad"].to_numpy()), axis=0)
        h = np.sum(np.stack(pdf["hess"].to_numpy()), axis=0).reshape(len(w), len(w))
        d = _step(g, h, w, l2)
        return pd.DataFrame({"annotator_id": [int(key[0])], "w": [(w + d).tolist()], "n_rows": [int(pdf["n"].sum())],
                             "steps": [steps], "converged": [float(np.abs(d).max()) <= HEAD_TOLERANCE]})

    return combine


def fit_annotator_heads(rows: DataFrame, dim: int, annotator: str = "annotator_id", features_col: str = "embedding",
                        label: str = "y", l2: float = 1.0, group_rows: int = HEAD_GROUP_ROWS,
                        vectors: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """K5: one binary logistic head per annotator on frozen features, fitted
    by Newton steps (L2-regularised) until the weights stand still.

    An annotator of at most ``group_rows`` rows is fitted whole, in a group
    with others: one shuffle of the rows, no passes. A more prolific one is split
    into parts of about that size; each pass reduces a part to one (gradient,
    Hessian) record, combines an annotator's records and takes a step, and only
    heads that still move enter the next pass. The heads of a pass are written
    to the shared checkpoint folder. With ``vectors`` (key, features) the rows
    hold the key alone; a task gets each vector of its rows once.

    Output: (annotator_id, weights array<array<double>>, bias array<double>,
    n_rows, steps, converged) in the two-label softmax form of
    :func:`score_with_heads` (label 0 gets the negated half of the binary head,
    label 1 the positive half).
    """
    d1 = dim + 1
    spark = rows.sparkSession
    held = features_col if vectors is None else key
    data = cut_lineage(rows.select(F.col(annotator).cast("bigint").alias("annotator_id"), F.col(held).alias("x"),
                                   F.col(label).cast("double").alias("y")).dropna(subset=["annotator_id"]))
    if vectors is not None:  # rows without a vector are no rows of a head
        data = data.dropna(subset=["x"])
    several = cut_lineage(data.groupBy("annotator_id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("bigint").alias("__parts")).filter("__parts > 1"))
    split_any = not several.isEmpty()
    one = data.join(several, "annotator_id", "left_anti") if split_any else data
    fit = _fit_group(l2)
    if vectors is None:
        n = data.count()
        tasks = max(spark.sparkContext.defaultParallelism, n // HEAD_TASK_ROWS)
        grouped = one.withColumn("group", F.pmod(F.xxhash64("annotator_id"), F.lit(n // group_rows + 1)))
        heads = grouped.repartition(tasks, "group").groupBy("group").applyInArrow(fit, _HEAD_SCHEMA)
    else:
        tasks = _head_tasks(data, vectors, dim)
        dealt = one.withColumn("deal", F.pmod(F.xxhash64("annotator_id"), F.lit(tasks)))
        heads = _cogroup(dealt, _vectors_of(dealt, vectors, key, features_col), tasks).applyInArrow(
            _fit_looked_up(fit), _HEAD_SCHEMA)
    if split_any:
        split = data.join(several, "annotator_id").withColumn(
            "part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")))
        if vectors is not None:
            found = vectors.select(F.col(key).alias("x"), F.col(features_col).alias("__x"))
            split = split.join(found, "x").drop("x").withColumnRenamed("__x", "x")
        split = cut_lineage(split.select("annotator_id", "x", "y", "part"))
        moving = several.select("annotator_id", F.array_repeat(F.lit(0.0), d1).alias("w"))
        for step in range(1, HEAD_MAX_STEPS + 1):
            stats = split.join(moving, "annotator_id").groupBy("annotator_id", "part").applyInPandas(
                _part_statistics, _STATS_SCHEMA)
            now = cut_lineage(stats.groupBy("annotator_id").applyInPandas(_combine_parts(l2, step), _HEAD_SCHEMA))
            last = step == HEAD_MAX_STEPS
            heads = heads.unionByName(now if last else now.filter("converged"))
            moving = now.filter("NOT converged").select("annotator_id", "w")
            if last or moving.isEmpty():
                break
    heads = cut_lineage(heads)
    half = F.transform("w", lambda v: v / 2.0)
    return heads.select(
        F.col("annotator_id").alias(annotator),
        F.array(F.transform(F.slice(half, 1, dim), lambda v: -v), F.slice(half, 1, dim)).alias("weights"),
        F.array(-F.element_at(half, d1), F.element_at(half, d1)).alias("bias"), "n_rows", "steps", "converged")
