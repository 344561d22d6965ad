"""One query for each corpus operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import (
    byte_bpe,
    filter_audit,
    language_model,
    lexical_search,
    license_scan,
    mixing,
    near_duplicates,
    substring_repeats,
    token_counts,
    top_k,
    toxicity,
    vector_duplicates,
    word_bpe,
)
from scanlake.llm.oracles import ORACLES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats.repeat_digests(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: How far sources, languages and topics are flattened (1: as they are, 0: uniform), and the share of tokens to sample.
MIX = {"source": 0.7, "lang": 0.7, "topic": 0.7}
MIX_SHARE = 0.5


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(documents(spark, sf_dir), MIX, MIX_SHARE, public_tokenizers.path("piece_bpe_32k.model"))
    return mixed.select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("off", 6).alias("off"), F.round("probability", 6).alias("probability"), "kept")


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.word_bpe_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_substring_dedup,
        op3_toxicity,
        op4_lm_scores,
        op5_license_scan,
        op6_near_duplicates,
        op7_byte_bpe,
        op8_top_k,
        op9_mixing,
        op10_embedding_duplicates,
        op11_lexical_search,
        op12_filter_audit,
        op13_word_bpe,
    )
}
