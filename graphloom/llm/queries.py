"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, langid, minhash, pii, product_quantisation, quality, suffix_dedup, token_files, toxicity
from .common import docs_of, held_out

#: The key of the PII pseudonyms in tests and queries; a deployment passes its own.
DEMO_KEY = "demo-key-not-secret"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(docs_of(spark, sf_dir), 400)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_quantisation.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(docs_of(spark, sf_dir), _labels(spark, sf_dir), ~held_out("doc_id", 5, 0))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(docs_of(spark, sf_dir), _labels(spark, sf_dir), ~held_out("doc_id", 5, 0), threshold=0.3)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(docs_of(spark, sf_dir), words=4, percent=80)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs_of(spark, sf_dir), DEMO_KEY).select("doc_id", "text", "n_pii")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(docs_of(spark, sf_dir), ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.tokenised(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_embedding_near_dedup, op4_toxicity, op5_quality, op6_minhash_near_dedup, op7_byte_bpe, op8_pii, op9_language_id, op10_token_files)
}
ORACLE_SQL: dict[str, str] = {}
