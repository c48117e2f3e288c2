"""Tasks of bounded size: shared steps deal their rows by the rows' number."""

from pyspark.sql import functions as F

from raterlens import session
from raterlens.operators import annotators as ann
from raterlens.operators import clean
from raterlens.operators import splits as sp
from raterlens.operators import welfare as wf
from raterlens.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ratings(spark, n=400):
    return spark.range(n).select((F.col("id") % 20).alias("text_id"), (F.col("id") % 7).alias("annotator_id"),
                                 (F.col("id") % 3 % 2).cast("int").alias("y"))


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(1000), "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    d = session.spread(spark.range(1000), "id")
    assert d.rdd.getNumPartitions() == 100 and d.count() == 1000


def test_profile_is_dealt_by_text(spark, monkeypatch):
    r = _ratings(spark)
    want = sorted(map(tuple, ann.annotator_profile(r).collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    many = ann.annotator_profile(r)
    assert "REPARTITION_BY_NUM" in _plan(many) and ", 80)" in _plan(many)
    assert [t[:2] for t in sorted(map(tuple, many.collect()))] == [t[:2] for t in want]


def test_welfare_is_shuffled_once(spark):
    """By annotator; counts, reports and baseline need no other exchange."""
    fact = _ratings(spark).select("annotator_id", (F.col("annotator_id") < 2).alias("extreme_annotator"), "y",
                                  (1 - F.col("y")).alias("personalised"), F.lit(1).alias("boundary"),
                                  (80.0 + F.col("text_id")).alias("confidence_score"))
    assert _plan(wf.annotator_welfare(fact)).count("Exchange hashpartitioning") == 1


def test_rows_of_few_repeated_keys_stay_where_they_are(spark):
    d = spark.range(300).select((F.col("id") % 298).alias("a"), F.lit(None).cast("long").alias("b"), "id")
    kept = clean.drop_repeated_keys(d, ["a", "b"])
    assert "BroadcastHashJoin" in _plan(kept) and "hashpartitioning" not in _plan(kept)
    assert kept.count() == 296


def test_trial_sums_are_not_shuffled(spark):
    """Masks are dealt by annotator; the 100 sums of an annotator stay in a task."""
    r = spark.range(2000).select((F.col("id") % 97).alias("text_id"), (F.col("id") % 11).alias("annotator_id"))
    texts, cutoffs = sp._trials(r, 5, 0.2, 0, "text_id")
    seen = []
    real = sp.cut_lineage
    try:
        sp.cut_lineage = lambda df: seen.append(_plan(df)) or real(df)
        sp._score_trials(r, texts, cutoffs, 5, 0, 12, "total", "annotator_id", "text_id").collect()
    finally:
        sp.cut_lineage = real
    (plan,) = seen
    assert plan.count("Exchange hashpartitioning(annotator_id") == 1 and "REPARTITION_BY_NUM" in plan


def test_stored_inputs_are_joined_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Where the right side is too large to be broadcast, tasks grow with the rows all the same."""
    sf, n = str(tmp_path), F.col("id")
    spark.range(400).select((n % 100).alias("l_orderkey"), (n % 150).alias("l_partkey"), (n % 50 + 1.0).alias("l_quantity"),
                            F.lit("A").alias("l_returnflag")).write.parquet(f"{sf}/lineitem.parquet")
    spark.range(100).select(n.alias("o_orderkey"), (n % 30).alias("o_custkey")).write.parquet(f"{sf}/orders.parquet")
    spark.range(150).select(n.alias("p_partkey"), F.lit("p").alias("p_name")).write.parquet(f"{sf}/part.parquet")
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "-1")
    try:
        raw, kept = fx.ratings_raw(spark, sf), fx.ratings(spark, sf)
    finally:
        spark.conf.unset(key)
    assert raw.count() == 400 and len(raw.inputFiles()) > 30 and len(kept.inputFiles()) > 30
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
