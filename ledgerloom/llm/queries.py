"""The operators' queries over the testdata tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import byte_bpe, centroids, decontaminate, embedding_dedup, language, maxent, merkle, mix, near_duplicates, private_data, quality, records, toxicity
from ledgerloom.session import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources."""
    return mix.digest(read_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.digest(read_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    return maxent.digest(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    return quality.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return near_duplicates.digest(read_table(spark, sf_dir, "documents"))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to record files and read back."""
    return records.digest(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return private_data.digest(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, and the root of its version where it is tampered with."""
    return merkle.digest(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to."""
    import public_tokenizers

    return byte_bpe.digest(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding."""
    return centroids.digest(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mix": op3_mix,
    "op4_language": op4_language,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_records": op9_records,
    "op10_private_data": op10_private_data,
    "op11_merkle": op11_merkle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_embedding_dedup": embedding_dedup.ORACLE,
    "op3_mix": mix.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
