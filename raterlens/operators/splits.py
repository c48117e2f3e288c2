"""Train/test splits that share no text and keep every annotator
(J6-J10, J32, G1-G5, C9).

A split is a ``split`` column ('train' / 'test') on the ratings, never two
copies of the data. The test texts are the first ``floor(fraction * n_texts)``
distinct texts in a seeded hash order (ties by text id). That set is described
by one cut-off pair (order key, text id): a text is in test iff its pair is at
or below the cut-off, so the split is a per-row column expression - no join of
the ratings back to a text list. The cut-off comes from a histogram of the
order keys (:func:`first_n_per_group`), so no task ever ranks all texts.

The best-of-N search does the same for N seeds at once. The order keys of
several seeds are slices of one digest. One pass over the distinct texts counts
each trial's keys below the range in which its cut-off lies, within the tasks,
and ranks the few keys inside it. The N cut-offs then turn each text into a bit
mask of the trials whose test set holds it, and one aggregation per annotator
sums the bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlens.config import MIN_TRAIN, N_SPLIT_TRIALS, ORDER_DIGITS, ORDER_KEYS, ORDER_RANGE, TEST_FRACTION
from raterlens.functions.columns import order_digest, order_key, seeded_order
from raterlens.operators.clean import dense_ids
from raterlens.operators.distinct import bitmap_distinct
from raterlens.operators.labels import first_n_per_group
from raterlens.operators.running import quantiles
from raterlens.session import ROWS_A_TASK, cut_lineage

TRAIN, TEST = "train", "test"


def _test_cutoffs(texts: DataFrame, text_id: str, fraction: float, seed: int) -> DataFrame:
    """Cut-off (``__co`` order key, ``__ct`` text id) of the test texts, one
    row. ``texts`` holds distinct text ids."""
    n = texts.agg(F.count(F.lit(1))).scalar()
    t = (texts.withColumn("__g", F.lit(0))
         .withColumn("__k", F.floor(F.lit(float(fraction)) * n).cast("bigint"))
         .withColumn("__ord", seeded_order(text_id, seed)))
    picked = first_n_per_group(t, "__g", "__ord", text_id, "__k", ORDER_RANGE)
    cut = picked.agg(F.max(F.struct(F.col("__ord"), F.col(text_id))).alias("__c"))
    return cut.select(F.col("__c.__ord").alias("__co"), F.col(f"__c.{text_id}").alias("__ct"))


def _is_test(text_id: str, seed, co: Column, ct: Column) -> Column:
    o = seeded_order(text_id, seed)
    return F.coalesce((o < co) | ((o == co) & (F.col(text_id) <= ct)), F.lit(False))


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two one-row frames side by side (one scalar subquery, no join)."""
    packed = other.select(F.struct(*other.columns).alias("__o")).scalar()
    return one.select(*one.columns, *[packed.getField(c).alias(c) for c in other.columns])


def split_on_texts(ratings: DataFrame, fraction: float = TEST_FRACTION, seed: int = 0,
                   text_id: str = "text_id") -> DataFrame:
    """Add ``split``; ``floor(fraction * n_texts)`` texts (seeded) are
    test, the rest train. The fraction argument is honoured."""
    cut = _test_cutoffs(ratings.select(text_id).distinct(), text_id, fraction, seed)
    c = cut.select(F.struct("__co", "__ct")).scalar()
    co, ct = c.getField("__co"), c.getField("__ct")
    return ratings.withColumn(
        "split", F.when(_is_test(text_id, F.lit(seed), co, ct), F.lit(TEST)).otherwise(F.lit(TRAIN)))


def annotator_split_counts(split_df: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """Per annotator: ratings in train and in test (one partial aggregate)."""
    s = F.col("split")
    return split_df.groupBy(annotator).agg(
        F.count_if(s == TRAIN).alias("n_train"), F.count_if(s == TEST).alias("n_test"))


def refine_splits(split_df: DataFrame, min_train: int = MIN_TRAIN, annotator: str = "annotator_id") -> DataFrame:
    """Drop, from both splits, annotators found in one split only or with
    fewer than ``min_train`` train ratings. Counts per annotator, then a semi
    join on the kept ids (AQE broadcasts them when small, splits skew)."""
    keep = (annotator_split_counts(split_df, annotator)
            .filter((F.col("n_train") >= min_train) & (F.col("n_test") > 0)).select(annotator))
    return split_df.join(keep, annotator, "left_semi")


def evaluate_splits(split_df: DataFrame, min_train: int = MIN_TRAIN, annotator: str = "annotator_id",
                    text_id: str = "text_id") -> DataFrame:
    """One row: test share of rows (``test_frac_samples``; the studied
    code labels this number the text-id fraction), true test share of
    distinct texts (``test_frac_text_ids``), share of annotators found in
    both splits (Jaccard of the two sets) and share of train annotators
    below ``min_train``."""
    s = F.col("split")
    rows = split_df.agg(F.avg((s == TEST).cast("double")).alias("test_frac_samples"))
    texts = bitmap_distinct(split_df, {"test": F.when(s == TEST, F.col(text_id)), "every": text_id})
    rows = _beside(rows, texts.select(F.try_divide("test", "every").alias("test_frac_text_ids")))
    per = annotator_split_counts(split_df, annotator)
    both = (F.col("n_train") > 0) & (F.col("n_test") > 0)
    ann = per.agg(
        (F.count_if(both) / F.count(F.lit(1))).alias("annotators_in_both_splits_frac"),
        F.try_divide(F.count_if((F.col("n_train") > 0) & (F.col("n_train") < min_train)),
                     F.count_if(F.col("n_train") > 0)).alias("annotators_below_min_train_frac"))
    return _beside(rows, ann)


def class_frequencies_by_split(split_df: DataFrame, label: str = "toxic_score") -> DataFrame:
    """Class fraction in train and in test and their absolute difference,
    for classes present in train (a class missing in test gives NULL) - one
    conditional aggregation instead of a join of two frequency tables."""
    s = F.col("split")
    totals = split_df.select(F.struct(F.count_if(s == TRAIN).alias("nt"),
                                      F.count_if(s == TEST).alias("ne"))).scalar()
    nt, ne = totals.getField("nt"), totals.getField("ne")
    g = split_df.groupBy(label).agg(F.count_if(s == TRAIN).alias("__ct"), F.count_if(s == TEST).alias("__ce"))
    g = g.filter(F.col("__ct") > 0).select(
        label, (F.col("__ct") / nt).alias("frac_train"),
        F.when(F.col("__ce") > 0, F.col("__ce") / ne).alias("frac_test"))
    return g.withColumn("abs_frac_diff", F.abs(F.col("frac_train") - F.col("frac_test")))


def annotator_sets(split_df: DataFrame, annotator: str = "annotator_id"):
    """Distinct annotators of train and of test."""
    s = F.col("split")
    return (split_df.filter(s == TRAIN).select(annotator).distinct(),
            split_df.filter(s == TEST).select(annotator).distinct())


def annotators_in_both(split_df: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """Annotators of train that are also in test (set intersection)."""
    tr, te = annotator_sets(split_df, annotator)
    return tr.intersect(te)


def annotators_one_split_only(split_df: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """Annotators found in one split only, with the split they are in."""
    tr, te = annotator_sets(split_df, annotator)
    return (tr.subtract(te).withColumn("only_in", F.lit(TRAIN))
            .unionByName(te.subtract(tr).withColumn("only_in", F.lit(TEST))))


def same_annotators(split_df: DataFrame, annotator: str = "annotator_id") -> DataFrame:
    """One row: annotator counts per split and whether the two sets are
    equal (their symmetric difference is empty)."""
    per = annotator_split_counts(split_df, annotator)
    return per.agg(F.count_if(F.col("n_train") > 0).alias("n_train_annotators"),
                   F.count_if(F.col("n_test") > 0).alias("n_test_annotators"),
                   F.coalesce(F.bool_and((F.col("n_train") > 0) == (F.col("n_test") > 0)), F.lit(True))
                   .alias("same_annotators"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """G1: stack two splits by column name; a column missing on one side is
    NULL there."""
    return (train.withColumn("split", F.lit(TRAIN))
            .unionByName(test.withColumn("split", F.lit(TEST)), allowMissingColumns=True))


def assign_annotator_ids(split_df: DataFrame, rater: str = "worker_id", id_col: str = "annotator_id") -> DataFrame:
    """Dense integer ids 1:1 with the raters of train (ascending
    rater), inner-joined to both splits - test raters absent from train are
    dropped."""
    ids = dense_ids(split_df.filter(F.col("split") == TRAIN), rater, id_col)
    return split_df.drop(id_col).join(ids, rater, "inner")


def split_checks(split_df: DataFrame, annotator: str = "annotator_id", text_id: str = "text_id") -> DataFrame:
    """One row over a finished split: texts and annotators of the
    merged data, share of texts with exactly two ratings, mean ratings per
    annotator, annotators per split and whether they are the same, median
    ratings per annotator in each split."""
    per_text = split_df.groupBy(text_id).agg(F.count(annotator).alias("__n"))
    texts = per_text.agg(F.count(F.lit(1)).alias("n_texts"),
                         F.avg((F.col("__n") == 2).cast("double")).alias("frac_texts_two_ratings"))
    per = cut_lineage(annotator_split_counts(split_df, annotator))
    ann = per.agg(
        F.count(F.lit(1)).alias("n_annotators"),
        F.avg(F.col("n_train") + F.col("n_test")).alias("mean_ratings_per_annotator"),
        F.count_if(F.col("n_train") > 0).alias("n_train_annotators"),
        F.count_if(F.col("n_test") > 0).alias("n_test_annotators"),
        F.coalesce(F.bool_and((F.col("n_train") > 0) == (F.col("n_test") > 0)), F.lit(True)).alias("same_annotators"))
    out = _beside(texts, ann)
    for side in ("train", "test"):
        m = quantiles(per.filter(F.col(f"n_{side}") > 0), [], f"n_{side}", {f"median_{side}_per_annotator": 0.5})
        out = _beside(out, m)
    return out


# --- best of N random splits (J9) ------------------------------------------

# The cut-offs are searched within so many standard deviations of the share of
# test texts below a key; if one lies outside, the range is widened.
WINDOW_SD, WIDEN = 8.0, 8.0
TEXTS_A_TASK = 100_000


def _keyed(texts: DataFrame, text_id: str, n_trials: int, seed: int) -> DataFrame:
    """``texts`` with each trial's order key (array ``__keys``): slices of one
    digest for ORDER_KEYS trials. Digests, not bytes, are the work: the ids are
    dealt out over all cores, or TEXTS_A_TASK each."""
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, texts.count() // TEXTS_A_TASK)
    digests = F.transform(F.sequence(F.lit(seed // ORDER_KEYS), F.lit((seed + n_trials - 1) // ORDER_KEYS)),
                          lambda b: order_digest(text_id, b))
    keys = F.flatten(F.transform(digests, lambda d: F.array(*[order_key(d, i) for i in range(ORDER_KEYS)])))
    return texts.repartition(tasks).select(text_id, F.slice(keys, seed % ORDER_KEYS + 1, n_trials).alias("__keys"))


def _trial_cutoffs(texts: DataFrame, text_id: str, n_trials: int, fraction: float, seed: int) -> dict:
    """Of each trial the last test text: {trial: (order key, id)}, one entry a
    trial; empty if the fraction leaves no test text.

    ``texts`` is a written table of n distinct ids. Order keys are uniform, so
    the cut-off lies within a few standard deviations of the fraction. One pass
    counts each trial's keys below that range, within the tasks, and keeps the
    keys in it: about 16 sqrt(n) a trial, which are ranked."""
    n = texts.count()
    k = math.floor(fraction * n)
    if k == 0:
        return {}
    share, half = k / n, WINDOW_SD * math.sqrt(k / n * (1 - k / n) / n) + 2 / n
    every = _keyed(texts, text_id, n_trials, seed).select(text_id, F.posexplode("__keys").alias("trial", "key"))
    while True:
        low, high = (f"{max(0, int(x * ORDER_RANGE)):0{ORDER_DIGITS}x}" for x in (share - half, share + half))
        key = F.col("key")
        near = every if share + half >= 1 else every.filter(key < high)
        counts = cut_lineage(near.groupBy("trial", F.when(key >= low, key).alias("key"),
                                          F.when(key >= low, F.col(text_id)).alias("id")).agg(F.count(F.lit(1)).alias("n")))
        below = F.broadcast(counts.filter("key IS NULL").select("trial", F.col("n").alias("below")))  # one row a trial
        rank = F.row_number().over(Window.partitionBy("trial").orderBy("key", "id"))
        found = counts.filter("key IS NOT NULL").withColumn("rank", rank).join(below, "trial", "left") \
            .filter(F.col("rank") == F.lit(k) - F.coalesce("below", F.lit(0))).select("trial", "key", "id").collect()
        if len(found) == n_trials:
            return {r["trial"]: (r["key"], r["id"]) for r in found}
        half *= WIDEN


def _trial_masks(texts: DataFrame, text_id: str, cutoffs: dict, n_trials: int, seed: int) -> DataFrame:
    """(text, __m0, __m1, ...): 64-bit masks of the trials whose test set
    holds the text; the cut-offs are constants of the plan."""
    def bit(i):
        return F.lit((1 << (i % 64)) - (1 << 64 if i % 64 == 63 else 0)).cast("bigint")

    zero = F.lit(0).cast("bigint")
    words = [range(64 * j, min(64 * j + 64, n_trials)) for j in range(-(-n_trials // 64))]

    def word(trials):
        cuts = F.array(*[F.struct(F.lit(cutoffs[i][0]).alias("key"), F.lit(cutoffs[i][1]).alias("id"), bit(i).alias("bit"))
                         for i in trials])
        held = F.zip_with(F.slice("__keys", trials[0] + 1, len(trials)), cuts, lambda k, c: F.when(
            (k < c["key"]) | ((k == c["key"]) & (F.col(text_id) <= c["id"])), c["bit"]).otherwise(zero))
        return F.aggregate(held, zero, lambda m, x: m.bitwiseOR(x))

    return _keyed(texts, text_id, n_trials, seed).select(text_id, *[
        (word(t) if cutoffs else zero).alias(f"__m{j}") for j, t in enumerate(words)])


def _trials(ratings: DataFrame, n_trials: int, fraction: float, seed: int, text_id: str):
    """Distinct texts (written) and the trials' cut-offs."""
    texts = cut_lineage(ratings.select(text_id).filter(F.col(text_id).isNotNull()).distinct())
    return texts, _trial_cutoffs(texts, text_id, n_trials, fraction, seed)


def split_trials(ratings: DataFrame, n_trials: int = N_SPLIT_TRIALS, fraction: float = TEST_FRACTION,
                 seed: int = 0, min_train: int = MIN_TRAIN, objective: str = "total",
                 annotator: str = "annotator_id", text_id: str = "text_id") -> DataFrame:
    """Score ``n_trials`` seeded splits (trial i uses seed + i), each
    refined as in :func:`refine_splits`. One row per trial: kept annotators,
    kept train and test rows, the objective and ``is_best``.

    Plan: the trials' cut-offs come from one pass over the distinct texts
    (:func:`_trial_cutoffs`); each text becomes one row with 64-bit masks of
    the trials in which it is test, so no (text x trial) row is shuffled. The
    masks are joined to the (text, annotator) pairs, these are dealt by
    annotator and a single aggregation sums the bits - one SUM per trial - as
    they stream by: no (rating x trial) row is ever materialised and no sums
    are shuffled (those of an annotator are larger than its masks).
    Train counts are the annotator's total minus its test count.

    ``objective="total"`` maximises kept train + test rows (the stated
    intent); ``"train"`` is twice the kept train rows (what the studied loop
    computes). Ties go to the earliest trial (strict improvement).
    """
    if objective not in ("total", "train"):
        raise ValueError(f"unknown objective {objective!r}")
    texts, cutoffs = _trials(ratings, n_trials, fraction, seed, text_id)
    return _score_trials(ratings, texts, cutoffs, n_trials, seed, min_train, objective, annotator, text_id)


def _score_trials(ratings: DataFrame, texts: DataFrame, cutoffs: dict, n_trials: int, seed: int,
                  min_train: int, objective: str, annotator: str, text_id: str) -> DataFrame:
    pairs = ratings.select(annotator, text_id)
    masks = _trial_masks(texts, text_id, cutoffs, n_trials, seed)
    # one row an annotator and 100 sums are larger than its ratings: dealt by annotator before they are summed
    r = pairs.join(masks, text_id, "left").drop(text_id)
    r = r.repartition(max(ratings.sparkSession.sparkContext.defaultParallelism, -(-ratings.count() // ROWS_A_TASK)), annotator)

    def bit(i):
        m = F.coalesce(F.col(f"__m{i // 64}"), F.lit(0).cast("bigint"))
        return F.shiftrightunsigned(m, i % 64).bitwiseAND(F.lit(1))

    counts = r.groupBy(annotator).agg(F.count(F.lit(1)).alias("__tot"),
                                      *[F.sum(bit(i)).alias(f"__t{i}") for i in range(n_trials)])
    per = counts.select(annotator, "__tot", F.explode(F.array(*[
        F.struct(F.lit(i).alias("trial"), F.col(f"__t{i}").alias("n_test")) for i in range(n_trials)])).alias("__e"))
    per = per.select(annotator, F.col("__e.trial").alias("trial"), F.col("__e.n_test").alias("n_test"),
                     (F.col("__tot") - F.col("__e.n_test")).alias("n_train"))
    per = per.filter(F.col("n_test") > 0)
    kept = per.filter(F.col("n_train") >= min_train)
    score = kept.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_annotators_kept"),
        F.sum("n_train").alias("n_train_rows"), F.sum("n_test").alias("n_test_rows"))
    # Trials that keep nobody still get a row.
    allt = ratings.sparkSession.range(n_trials).withColumnRenamed("id", "trial")
    score = allt.join(score, "trial", "left").fillna(0, ["n_annotators_kept", "n_train_rows", "n_test_rows"])
    obj = (F.col("n_train_rows") + F.col("n_test_rows")) if objective == "total" else 2 * F.col("n_train_rows")
    # n_trials rows: written once, so picking the best trial reads this small
    # table instead of re-running the scoring plan inside a subquery.
    score = cut_lineage(score.withColumn("objective", obj.cast("bigint")))
    best = score.agg(F.max_by("trial", F.struct(F.col("objective"), -F.col("trial")))).scalar()
    return score.withColumn("is_best", F.col("trial") == best)


def best_split(ratings: DataFrame, n_trials: int = N_SPLIT_TRIALS, fraction: float = TEST_FRACTION,
               seed: int = 0, min_train: int = MIN_TRAIN, objective: str = "total",
               annotator: str = "annotator_id", text_id: str = "text_id") -> DataFrame:
    """The winning trial's split, refined. The cut-offs that scored the
    trials also split the ratings."""
    if objective not in ("total", "train"):
        raise ValueError(f"unknown objective {objective!r}")
    texts, cutoffs = _trials(ratings, n_trials, fraction, seed, text_id)
    scores = _score_trials(ratings, texts, cutoffs, n_trials, seed, min_train, objective, annotator, text_id)
    win = scores.filter("is_best").first()["trial"]
    key, ct = cutoffs.get(win, ("", None))
    co = F.lit(int(key, 16)) if key else F.lit(None).cast("bigint")
    s = ratings.withColumn("split", F.when(
        _is_test(text_id, seed + win, co, F.lit(ct)), F.lit(TEST)).otherwise(F.lit(TRAIN)))
    return refine_splits(s, min_train, annotator)
