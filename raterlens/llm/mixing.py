"""Mixing sources to target weights: temperature mixing and budgeted block
permutations, with DataFrame functions only.

Shares p of the sources' words are raised to an exponent and normalised. The
exponent in [0, 1] is bisected (inside one expression over the array of
shares, one element a source): the largest one whose weights reach the target
entropy, raised as far as the repetition limit asks. A source of n words with
weight w then gets w * budget words (rounded): whole passes over the source and, for the
rest, the start of a keyed permutation. The permutation orders blocks of
documents (by a hash of the id) and, inside the one block where the budget
runs out, documents; so a source of any size needs sums by block and one
ranked block, never a sort of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.session import cut_lineage

TARGET_ENTROPY = 0.95   # share of ln(number of sources)
MAX_REPEAT = 4.0        # words drawn from a source over its words
BUDGET = 1.0            # words of the mix over words of the corpus
SEED = 17
STEPS = 60
BLOCK_DIGITS = 3        # 16 ** 3 blocks a source
WORD = "[^ \\t\\n\\r]+"


def _n_words():
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def _exponent(target: float, limit: float, budget: float):
    """Exponent for the array column ``p`` of shares."""
    z = "aggregate(p, 0D, (s, x) -> s + pow(x, (b.lo + b.hi) / 2))"
    u = "aggregate(p, 0D, (s, x) -> s + pow(x, (b.lo + b.hi) / 2) * ln(x))"
    enough = f"ln({z}) - (b.lo + b.hi) / 2 * {u} / {z} >= {target!r}D * ln(size(p))"
    # the repetition of a source is w * budget / p, largest for the smallest share
    repeats = f"pow(array_min(p), (b.lo + b.hi) / 2 - 1) / {z} * {budget!r}D > {limit!r}D"

    def bisect(go_up):
        return (f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> "
                f"named_struct('lo', if({go_up}, (b.lo + b.hi) / 2, b.lo), "
                f"'hi', if({go_up}, b.hi, (b.lo + b.hi) / 2)), b -> b.hi)")

    return F.expr(f"greatest({bisect(enough)}, {bisect(repeats)})")


def source_mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeat: float = MAX_REPEAT,
               budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """How often each document appears in the mix.

    ``docs`` needs doc_id, source and text; further columns are ignored.
    Returns a row for every input row: doc_id, source, n_words, weight of the
    source (6 digits) and copies (0 and up). Words are runs of characters
    other than space, tab, line feed and carriage return.

    A null source is the source ''. Null and empty texts have no words; they
    take the copies of their place in the order and cost nothing. A source
    without any word has weight 0 and copies 0. Ties of the order are broken
    by doc_id and n_words, so equal rows may differ only from each other. If
    no exponent meets the repetition limit (budget > max_repeat) the natural
    shares are used. An empty table gives no rows. Of a very long text only the
    number of its words leaves the task that reads it.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        _n_words().alias("n_words"), digest.alias("digest"))
        .withColumn("block", F.substring("digest", 1, BLOCK_DIGITS)))
    blocks = cut_lineage(rows.groupBy("source", "block").agg(F.sum("n_words").alias("words")))
    sources = blocks.groupBy("source").agg(F.sum("words").alias("n")).filter("n > 0")
    listed = (sources.agg(F.array_sort(F.collect_list(F.struct("n", "source"))).alias("s"))
              .withColumn("total", F.expr("aggregate(s, 0L, (a, x) -> a + x.n)"))
              .withColumn("p", F.expr("transform(s, x -> x.n / CAST(total AS DOUBLE))"))
              .filter("size(s) > 0"))
    mixed = (listed.withColumn("e", _exponent(float(target_entropy), float(max_repeat), float(budget)))
             .withColumn("z", F.expr("aggregate(p, 0D, (a, x) -> a + pow(x, e))"))
             .select("total", "e", "z", F.explode("s").alias("x"))
             .select(F.col("x.source").alias("source"), F.col("x.n").alias("n"),
                     F.expr("pow(x.n / CAST(total AS DOUBLE), e) / z").alias("w"), "total"))
    plan = (mixed.withColumn("words_due", F.expr(f"CAST(floor(w * total * {float(budget)!r}D + 0.5D) AS BIGINT)"))
            .select("source", F.round("w", 6).alias("weight"),
                    F.expr("words_due div n").alias("passes"), F.expr("words_due % n").alias("rest")))
    # blocks in the source's own order; `before` = words of the blocks ahead
    order = Window.partitionBy("source").orderBy(
        F.md5(F.concat("block", F.lit("|"), "source", F.lit(f"|{seed}"))), "block")
    placed = (blocks.withColumn("before", F.coalesce(
        F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(plan, "source", "left"))
    cut = placed.select(
        "source", "block", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("passes", F.lit(0)).alias("passes"),
        F.when(F.col("rest").isNull() | (F.col("before") >= F.col("rest")), F.lit("out"))
        .when(F.col("before") + F.col("words") <= F.col("rest"), F.lit("in")).otherwise(F.lit("cut")).alias("state"),
        (F.col("rest") - F.col("before")).alias("left"))
    cut = cut_lineage(cut)
    known = rows.join(cut, ["source", "block"])
    whole = known.filter("state <> 'cut'").select(
        "doc_id", "source", "n_words", "weight",
        (F.col("passes") + (F.col("state") == "in").cast("bigint")).cast("bigint").alias("copies"))
    inside = Window.partitionBy("source", "block").orderBy("digest", "doc_id", "n_words") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partly = known.filter("state = 'cut'").withColumn("sum", F.sum("n_words").over(inside)).select(
        "doc_id", "source", "n_words", "weight",
        (F.col("passes") + (F.col("sum") <= F.col("left")).cast("bigint")).cast("bigint").alias("copies"))
    return whole.union(partly)


_S = "(b.lo + b.hi) / 2"
_Z = f"list_sum(list_transform(p, lambda x: pow(x, {_S})))"
_U = f"list_sum(list_transform(p, lambda x: pow(x, {_S}) * ln(x)))"

ORACLE_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_words,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{SEED}') AS digest
  FROM documents),
blocks AS (
  SELECT source, substr(digest, 1, {BLOCK_DIGITS}) AS block, CAST(sum(n_words) AS BIGINT) AS words
  FROM rows_ GROUP BY 1, 2),
sources AS (SELECT source, CAST(sum(words) AS BIGINT) AS n FROM blocks GROUP BY 1 HAVING sum(words) > 0),
listed AS (
  SELECT list(n / CAST(t AS DOUBLE) ORDER BY n, source) AS p
  FROM sources, (SELECT sum(n) AS t FROM sources)),
up AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT b.i, b.lo, b.hi, {_S} AS mid,
           ln({_Z}) - {_S} * {_U} / {_Z} >= {TARGET_ENTROPY} * ln(len(p)) AS ok
    FROM up b, listed WHERE b.i < {STEPS})),
rep AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT b.i, b.lo, b.hi, {_S} AS mid,
           pow(list_min(p), {_S} - 1) / {_Z} * {BUDGET} > {MAX_REPEAT} AS ok
    FROM rep b, listed WHERE b.i < {STEPS})),
e AS (SELECT greatest((SELECT hi FROM up WHERE i = {STEPS}), (SELECT hi FROM rep WHERE i = {STEPS})) AS e),
mixed AS (
  SELECT source, n, pow(n / CAST(t AS DOUBLE), e) / sum(pow(n / CAST(t AS DOUBLE), e)) OVER () AS w, t
  FROM sources, e, (SELECT sum(n) AS t FROM sources)),
plan AS (
  SELECT source, round(w, 6) AS weight, CAST(floor(w * t * {BUDGET} + 0.5) AS BIGINT) // n AS passes,
         CAST(floor(w * t * {BUDGET} + 0.5) AS BIGINT) % n AS rest
  FROM mixed),
placed AS (
  SELECT source, block, words, coalesce(sum(words) OVER (
           PARTITION BY source ORDER BY md5(block || '|' || source || '|{SEED}'), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM blocks),
summed AS (
  SELECT r.*, before, sum(n_words) OVER (
           PARTITION BY r.source, block ORDER BY digest, doc_id, n_words ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ r JOIN placed b ON r.source = b.source AND substr(digest, 1, {BLOCK_DIGITS}) = b.block)
SELECT doc_id, s.source, n_words, coalesce(weight, 0) AS weight,
       CAST(CASE WHEN rest IS NULL THEN 0 WHEN before < rest AND before + upto <= rest THEN passes + 1
            ELSE passes END AS BIGINT) AS copies
FROM summed s LEFT JOIN plan ON s.source = plan.source
"""
