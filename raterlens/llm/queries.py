"""The thin queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from raterlens.llm import (bpe, exact_dedup, filter_audit, html_extract, langid, licenses, minhash, mixing, packing,
                           pii, prefix_trie, toxicity, vec_dedup)
from raterlens.llm.common import LOWER, UPPER
from raterlens.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("spans")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mix(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                              public_tokenizers.path(TOKENIZER))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op6_vec_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_dedup.embedding_duplicates(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                   read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                        public_tokenizers.path(WORD_TOKENIZER))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]),
                              read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_html_text": op2_html_text,
    "op3_source_mix": op3_source_mix,
    "op4_bpe": op4_bpe,
    "op5_langid": op5_langid,
    "op6_vec_dedup": op6_vec_dedup,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op3_source_mix": mixing.ORACLE_SQL,
    "op6_vec_dedup": vec_dedup.ORACLE_SQL,
    "op7_minhash": minhash.ORACLE_SQL,
    "op10_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
