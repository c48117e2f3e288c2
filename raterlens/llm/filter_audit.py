"""Filter interaction audit: what five document filters remove alone, after one
another and on average over all orders.

A row's failures of A to D are one bit each, from expressions over its text.
E (identical to the text of a smaller doc_id) is an existential self-join: a
left-semi join on hash, exact text and smaller doc_id.

* The right side of the join is one row a text: its smallest doc_id. A smaller
  one exists exactly if the smallest is smaller, so groups of any size arrive
  as one row a task.
* Only rows whose hash occurs twice can fail E. Their hashes set bits of a
  fixed number of bitmaps, and the second scan lets only texts pass whose bit
  is set. A wrong bit costs a row in the exchange, never a result.
* A hash with more than 1 / HEAVY of the rows is salted, so its copies meet
  their one right row in several tasks.

The rows that fail E move from their combination of bits to the one with E:
all rows are united with them (one less there, one more here) and counted by
(part, bits). At most 32 combinations a part are left, from which the 600 rows
of its 120 orders are expressions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.llm.common import cells_of, heavy_keys, in_cells
from raterlens.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
# Words are runs of characters other than space and U+0009 to U+000D.
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#$%&*|]"
E_BIT = 1 << FILTERS.index("E")


def _bits(text):
    """Failures of A to D, bit 0 for A."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    tests = [n < MIN_WORDS,
             F.lit(100) * distinct < F.lit(MIN_DISTINCT_PERCENT) * n,
             F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(MAX_CAPITAL_PERCENT) * F.length(text),
             text.rlike(SYMBOLS)]
    bits = F.lit(0)
    for i, failed in enumerate(tests):
        bits = bits + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return words, bits


def failing_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, part, bits of A to D) and, of them, those that fail E."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("hash", F.xxhash64("text"))
    words, bits = _bits(F.col("text"))
    marked = cut_lineage(rows.withColumn("__words", words).select("doc_id", "part", bits.alias("bits"), "hash"))
    known = marked.filter(F.col("doc_id").isNotNull())
    counts = cut_lineage(known.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    heavy = heavy_keys(counts, marked.count())  # hash, salts
    suspects = in_cells(rows.filter(F.col("doc_id").isNotNull()), "hash", cells_of(counts, "hash"))
    salted = suspects.join(F.broadcast(heavy), "hash", "left")
    left = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))))
    right = (suspects.groupBy("hash", "text").agg(F.min("doc_id").alias("smallest"))
             .join(F.broadcast(heavy), "hash", "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1))))
    l, r = left.alias("l"), right.alias("r").hint("merge")  # texts: no broadcast
    again = l.join(r, (F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt"))
                   & (F.col("l.text") == F.col("r.text")) & (F.col("r.smallest") < F.col("l.doc_id")), "left_semi")
    again = again.withColumn("__words", words).select("doc_id", "part", bits.alias("bits"))
    return marked.select("doc_id", "part", "bits"), again


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good and toxic rows by (part, bits)."""
    rows, again = failing_rows(docs)
    again = cut_lineage(again)
    moved = (rows.withColumn("n", F.lit(1))
             .unionByName(again.withColumn("n", F.lit(-1)))
             .unionByName(again.withColumn("bits", F.col("bits") + E_BIT).withColumn("n", F.lit(1)))
             .groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n")).filter("n <> 0"))
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return (moved.join(marks, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")))


def _total(condition: str, value: str = "n"):
    return F.expr(f"aggregate(cells, 0L, (s, x) -> s + if({condition}, x.{value}, 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of the filters A to E removes, by part.

    ``docs`` needs doc_id, source and text, ``labels`` doc_id, quality and
    toxic; further columns are ignored. Returns 600 rows for each source value
    (part, null being ''): filter_order, step, and counts of rows: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the
    filter's removed, summed over the 120 orders).

    Null and empty texts are equal to each other and have no words. Rows
    without a doc_id are counted, but have no order: they neither fail E nor
    make others fail it. Repeated rows count each; rows of one doc_id don't
    make each other fail E. A doc_id labelled more than once is good (toxic)
    if one of its label rows says so. An empty table gives no rows. A very
    long text needs memory for its list of words, about ten times its size,
    in one task at a time.
    """
    cells = combinations(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    steps = (cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("bit", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)"))
             .withColumn("before", F.expr(
                 "aggregate(sequence(0, step - 1), 0, (m, i) -> if(i = 0, 0, "
                 "m | shiftleft(1, ascii(substr(filter_order, i, 1)) - 65)))")))
    first = "(x.bits & before) = 0 AND (x.bits & bit) <> 0"
    return steps.select(
        "part", "filter_order", "step",
        _total("(x.bits & (before | bit)) = 0").alias("kept"),
        _total(first).alias("removed"),
        _total("(x.bits & before) <> 0 AND (x.bits & bit) <> 0").alias("redundant"),
        _total("x.bits = bit").alias("unique_fails"),
        _total(first, "good").alias("good_lost"),
        _total(first, "toxic").alias("toxic_lost"),
        # a row is removed by the first of its k failing filters: by each in 120 / k orders
        F.expr("aggregate(cells, 0L, (s, x) -> s + if((x.bits & bit) <> 0, x.n * (120 div bit_count(x.bits)), 0L))")
        .alias("shapley"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
smallest AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY 1),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS dd, coalesce(first_id < d.doc_id, false) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN smallest USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS bits,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, CAST(1 << (ascii(substr(filter_order, step, 1)) - 65) AS INT) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda i:
           1 << (ascii(substr(filter_order, CAST(i AS INT), 1)) - 65))), 0) AS INT) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
         CAST(sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN bits & before <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
