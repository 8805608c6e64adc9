"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tierscope.llm import lang_id
from tierscope.llm.bm25_decontam import without_leaks
from tierscope.llm.byte_bpe import encode_digests
from tierscope.llm.common import join_checked, read, stored
from tierscope.llm.ngram_jaccard import group_documents
from tierscope.llm.queries import TOKENIZER
from tierscope.llm.secret_scan import redact_secrets

#: Words of a shingle and least similarity in percent of the near-duplicate stage; op10 as a query has its own.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what has no letters, or no clear language, goes."""
    return lang_id.accepted(docs, lang_id.train(docs, public_tokenizers.path(TOKENIZER)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, 80 percent or more alike, the one with the smallest id stays."""
    gone = stored(group_documents(docs, k=STAGE_SHINGLE, percent=STAGE_PERCENT).where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    return join_checked(docs, gone, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids' and decoded bytes' digests of what is left."""
    return encode_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark_leaks), ("secret_scan", redact), ("byte_level_bpe", tokenize)]

#: SQL can't express the stages (learned models, BPE); tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
