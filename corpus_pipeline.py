"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read again by the next.

Language ID drops rejected documents, near-dedup keeps one document of each group, decontamination drops documents that hold
a benchmark item, PII replaces personal values in the text, and byte-level BPE encodes what is left. All stages but the last return the
columns of documents, further ones included. Where a stage judges each row by its own text the row's columns travel with it, and no text is shuffled.
Documents are told apart by doc_id: rows with a null doc_id cannot be judged and go in the first stage.
Null and empty texts have no language and go there too. Rows that repeat a doc_id are one document in near-dedup: all of them stay or go
(see ``minhash``). An empty table gives an empty result.

The key of the pseudonyms is read from the session's setting ``graphloom.pii.key``; tests and demonstrations use ``DEMO_KEY``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontamination, langid, minhash, pii
from graphloom.llm.common import held_out, written
from graphloom.llm.queries import DEMO_KEY


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, and ``row`` with all columns but the text, so that no name can clash with an operator's results."""
    return docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.identify(_packed(docs.where("doc_id IS NOT NULL")), ~held_out("doc_id", 4, 2), carry=("text", "row"))
    return _unpacked(judged.where("NOT rejected"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", "row"))
    return _unpacked(found.where("NOT contaminated"), docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs, spark.conf.get("graphloom.pii.key", DEMO_KEY), count_col="n_pii" if "n_pii" not in docs.columns else "_pii_count")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", pseudonymise), ("byte_bpe", byte_bpe)]
#: Language models, sketches and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
