"""Corpus pipeline: language, exact copies, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns a DataFrame; all but the last return the columns of docs.
Filters are joins on doc_id, so extra columns pass through unchanged.

Rows without a doc_id have no identity that a decision could name; the first
stage drops them. Repeated rows of a doc_id are one document: the exact stage
keeps one of them. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlens.llm import bpe, exact_dedup, langid, minhash, mixing
from raterlens.llm.queries import TOKENIZER
from raterlens.session import cut_lineage
from raterlens.sources.tables import read_table

REJECT_MARGIN = 2 / 15      # a text's language must be so far from chance (0) to certainty (1)
KEY = "__stage_doc_id"


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (one column, KEY). The ids grow with
    the input: the join is the same at every size, never a broadcast."""
    ids = ids.hint("merge")
    return docs.join(ids, docs["doc_id"].cast("bigint") == ids[KEY], "left_semi")


def least_score(languages: int) -> float:
    """Score below which a text is of none of so many languages: a fixed share
    of the way from chance, which is 1 / languages. With one language nothing
    can be told apart and nothing is rejected."""
    return 0.0 if languages < 2 else 1 / languages + REJECT_MARGIN * (1 - 1 / languages)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (und) and those of no language known."""
    net = langid.train(docs)
    found = langid.identify(docs, net).filter(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_score(len(net["labels"])))
        & F.col("doc_id").isNotNull())
    return _keep(docs, cut_lineage(found.select(F.col("doc_id").alias(KEY))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of equal texts, that of the largest doc_id."""
    kept = exact_dedup.exact_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias(KEY)).agg(
        F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(kept)
    once, often = kept.filter("n = 1").select(KEY), kept.filter("n > 1").select(KEY)
    out = _keep(docs, once)
    if not often.isEmpty():  # repeated rows of a doc_id
        out = out.union(_keep(docs, often).dropDuplicates(["doc_id"]))
    return out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies, that of the smallest doc_id."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(KEY))
    return _keep(docs, cut_lineage(kept))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it. Null and empty texts have the
    copies of their place in the order; a null source is the source ''. Rows
    that share a doc_id (none after the stages before) count as the largest."""
    mix = mixing.source_mix(docs).filter("copies > 0").select(F.col("doc_id").alias(KEY), F.col("copies").alias("__copies"))
    mix = cut_lineage(mix.groupBy(KEY).agg(F.max("__copies").alias("__copies"))).hint("merge")
    return docs.join(mix, docs["doc_id"].cast("bigint") == mix[KEY]) \
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix and the digest of what they decode
    to, a row for every input row: repeated rows repeat, a null text has none."""
    out = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_weights", source_weights),
    ("tokens", tokens),
]

# The language stage is a trained network, which SQL can't express. The tests hold the other stages against plain
# computations over what it keeps, and its classifier against a plain evaluation of the network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
