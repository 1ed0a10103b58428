"""Seals of files: a digest kept beside a file, and the check that the file still has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import file_digests

SUFFIX = ".sha256"


def seals(spark: SparkSession, path: str) -> DataFrame:
    """(path, sealed) of the seal files at ``path``: the first word of each, in lower case."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    return rows.select(F.regexp_replace("p", r"\.sha256$", "").alias("path"), F.lower(F.split_part(F.trim(F.regexp_replace("value", r"\s+", " ")), F.lit(" "), F.lit(1))).alias("sealed"))


def verify(files: DataFrame, sealed: DataFrame) -> DataFrame:
    """(path, status): VALID, CHANGED, UNSEALED (no seal) or MISSING (a seal without its file), from file_digests and seals."""
    both = files.join(sealed, "path", "full_outer")
    status = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("sealed").isNull(), "UNSEALED").when(F.col("sha256") == F.col("sealed"), "VALID").otherwise("CHANGED")
    return both.select("path", status.alias("status"))


def verify_path(spark: SparkSession, pattern: str) -> DataFrame:
    """``verify`` for the files of a glob pattern and the seals beside them."""
    files = file_digests(spark, pattern).where(~F.col("path").endswith(SUFFIX))
    # Both readers give a URI, one with one slash after the scheme and the other with three.
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    return verify(files.withColumn("path", plain("path")), seals(spark, pattern + SUFFIX).withColumn("path", plain("path")))
