"""Registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, embedding_dedup, lang_id, license_digest, ngram_jaccard, quality_rules, spelling_variants, substring_dedup
from .bm25_decontam import find_leaks
from .byte_bpe import encode_digests
from .common import held_out, read
from .ngram_jaccard import group_documents
from .lm_score import score_by_models
from .quality_qda import score_quality
from .secret_scan import scan_secrets

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_by_models(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.train(docs, public_tokenizers.path(TOKENIZER))
    return lang_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op9_bm25_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(read(spark, sf_dir, "documents"))


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations", even=False)).drop("node")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_qda, op2_secret_scan, op3_substring_dedup, op4_license_digest, op5_lm_score, op6_embedding_dedup, op7_lang_id, op8_byte_bpe, op9_bm25_decontam, op10_ngram_jaccard, op11_rule_ledger, op12_prefix_trie, op13_spelling_variants)}

#: DuckDB SQL by query; a query without one is tested against a brute-force version in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_license_digest": license_digest.oracle_sql(),
    "op6_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op10_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
    "op11_rule_ledger": quality_rules.oracle_sql(),
    "op12_prefix_trie": conversation_trie.ORACLE_SQL,
    "op13_spelling_variants": spelling_variants.ORACLE_SQL,
}
