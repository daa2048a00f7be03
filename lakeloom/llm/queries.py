"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, jaccard, langid, licenses, lm, media, merkle, mixing, oracles, quality, tokens


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).documents.drop("source")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edited_fingerprints(documents(spark, sf_dir))
    return found.withColumn("changed_sections", F.array_join("changed_sections", ","))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(documents(spark, sf_dir), with_media=False)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_merkle, op4_byte_bpe, op5_jaccard, op6_lm_scores, op7_media, op8_licenses, op9_language, op10_quality)}


def oracle_sql() -> dict[str, str]:
    """The other operators' results need a tokenizer's file, a container's bytes or a trained model; tests hold them to brute force."""
    return {"op1_mixing": oracles.OP1, "op3_merkle": oracles.OP3, "op5_jaccard": oracles.OP5, "op8_licenses": oracles.OP8}
