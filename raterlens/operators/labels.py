"""Label aggregation jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raterlens.functions.columns import seeded_order


def majority_labels(ratings: DataFrame, text_id: str = "text_id", label: str = "toxic_score",
                    tie_break: str = "min") -> DataFrame:
    """D3: most frequent label per text; ties go to the lowest label
    (``tie_break="max"``: highest). Two partial aggregates, so a text holding
    a third of all rows never lands whole in one task."""
    return _most_frequent(ratings, [text_id], label, tie_break)


def _most_frequent(ratings: DataFrame, keys: Sequence[str], label: str, tie_break: str) -> DataFrame:
    """``keys`` and the most frequent label (integers below 2^31 in size). Count
    and label are one number, whose maximum is a hash aggregate; a missing
    label ranks below all others of its count."""
    counts = ratings.groupBy(*keys, F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    side = -1 if tie_break == "min" else 1
    place = F.coalesce(F.col("__l").cast("bigint") * side + F.lit(1 << 31), F.lit(0))
    best = counts.groupBy(*keys).agg(F.max(F.col("__n") * F.lit(1 << 32) + place).alias("__b"))
    place = F.col("__b") % F.lit(1 << 32)
    return best.select(*keys, F.when(place > 0, (place - F.lit(1 << 31)) * side).cast(
        counts.schema["__l"].dataType).alias("label"))


def majority_vote(ratings: DataFrame, text: str = "comment", text_id: str = "text_id",
                  label: str = "toxic_score", tie_break: str = "min", by: Sequence[str] = ()) -> DataFrame:
    """One row per text: (text_id, text, majority label), per ``by``
    group if given. Labels are counted by id, in hash aggregates over numbers;
    the text, constant within an id, is attached to the one row of its id."""
    by = list(by)
    votes = _most_frequent(ratings, [*by, text_id], label, tie_break)
    texts = ratings.select(text_id, F.col(text).alias("text")).dropDuplicates([text_id])
    same = votes[text_id].eqNullSafe(texts[text_id])
    return votes.join(texts, same).select(*[votes[c] for c in by], votes[text_id], "text", "label")


def first_n_per_group(df: DataFrame, group, order_key: str, tiebreak: str, n_col: str,
                      key_range: int, n_buckets: int = 65536) -> DataFrame:
    """Rows whose rank by (order_key, tiebreak) within ``group`` is <= the
    row's ``n_col`` - exact, without ranking a whole group in one task.

    ``order_key`` lies in [0, key_range). A histogram of (group, key bucket)
    (a partial aggregate; at most groups x n_buckets rows) locates, per
    group, the buckets that are fully in and the single boundary bucket;
    only the boundary bucket (about 1/n_buckets of a group's rows) is ranked
    by a window. The histogram never has more rows than distinct keys.
    """
    group = [group] if isinstance(group, str) else list(group)
    width = max(1, -(-key_range // n_buckets))
    b = df.withColumn("__bucket", F.floor(F.col(order_key) / F.lit(width)).cast("bigint"))
    hist = b.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*group).orderBy("__bucket")
    hist = hist.select(*group, "__bucket",
                       F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
                       F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("__upto"))
    hist = hist.withColumn("__before", F.coalesce(F.col("__before"), F.lit(0)))
    j = b.join(hist, [*group, "__bucket"])
    whole = j.filter(F.col("__upto") <= F.col(n_col))
    edge = j.filter((F.col("__before") < F.col(n_col)) & (F.col("__upto") > F.col(n_col)))
    rw = W.partitionBy(*group, "__bucket").orderBy(order_key, tiebreak)
    edge = edge.withColumn("__rn", F.row_number().over(rw)).filter(
        F.col("__rn") <= F.col(n_col) - F.col("__before")).drop("__rn")
    return whole.unionByName(edge).drop("__bucket", "__before", "__upto")


def balance_classes(majority: DataFrame, seed: int = 0, label: str = "label",
                    key: str = "text_id", by=()) -> DataFrame:
    """Subsample every class to the size of the smallest class (per
    ``by`` group, e.g. per split); the kept rows of a class are the first by
    the seeded hash of the key (ties by key)."""
    from raterlens.config import ORDER_RANGE

    by = [by] if isinstance(by, str) else list(by)
    counts = majority.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__cls_n"))
    if by:
        m = counts.groupBy(*by).agg(F.min("__cls_n").alias("__m"))
        d = majority.join(F.broadcast(m), by)  # one row per group
    else:
        d = majority.withColumn("__m", counts.agg(F.min("__cls_n")).scalar())
    d = d.withColumn("__ord", seeded_order(key, seed))
    out = first_n_per_group(d, [*by, label], "__ord", key, "__m", ORDER_RANGE)
    return out.drop("__ord", "__m")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and fraction of each label."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fraction", F.col("n") / total)


def class_weights(df: DataFrame, label: str = "label", inverse: bool = False) -> DataFrame:
    """Class frequency per label (the studied workflow uses frequency,
    not inverse frequency); ``inverse=True`` gives total / (k * n_class)."""
    dist = label_distribution(df, label)
    if inverse:
        k = dist.agg(F.count(F.lit(1))).scalar()
        return dist.withColumn("weight", F.lit(1.0) / (F.col("fraction") * k))
    return dist.withColumn("weight", F.col("fraction"))


def restrict_to_texts(data: DataFrame, other: DataFrame, key: str = "text_id", drop_key: bool = True) -> DataFrame:
    """Keep rows whose text occurs in ``other`` (semi join)."""
    out = data.join(other.select(key), key, "left_semi")
    return out.drop(key) if drop_key else out
