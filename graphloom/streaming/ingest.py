"""Streaming ingest of bibliographic records: an extension, as everything else here works on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import SCHEMA


def stream_records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files below ``path`` as rows of SCHEMA; a broken line stops the stream instead of giving nulls."""
    return spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(path)


def append_records(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append records to a Parquet table by source; the file sink's log makes a replayed batch count once. Ends when the input is read."""
    return records.writeStream.partitionBy("source").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet")


def windowed_counts(events: DataFrame, time_col: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows per window and key (start, key, n); rows later than ``late`` behind the newest time may be left out once their window is closed."""
    grouped = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
