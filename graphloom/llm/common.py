"""Helpers shared by the training-data operators; storage and components are those of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import drop_path, dropped, fresh_path, shared_dir, written

__all__ = ["among", "components", "docs_of", "drop_path", "dropped", "fresh_path", "held_out", "keyed", "lowest", "released", "shared_dir", "tidy", "written"]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the worker's freed memory given back to the system when a task ends.

    Workers live on between tasks; what their allocators hold back would count against the executor beside the JVM.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def released() -> None:
    """Give the worker's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


#: Bits of a filter at most (8 MB), and bits for each key below that.
MOST_BITS, BITS = 1 << 26, 16


def among(rows: DataFrame, column: str, keys: DataFrame, flag: str | None = None) -> DataFrame:
    """The rows whose ``column`` may be one of the values of ``keys`` (one column of the same type): all that are, and a few that are not.

    With ``flag`` all rows come back, and that column tells which these are.

    Ahead of an exact join, so that only these rows are shuffled. The keys' hashes are bits of maps of 4 kB each, which are broadcast: at most
    MOST_BITS. Of many more keys than that the filter lets most rows pass, and the join behind it gives the same rows.
    """
    bits = 1 << 15
    wanted = BITS * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = keys.select(bit(keys.columns[0]).alias("h")).select((F.col("h") / 32768).cast("int").alias("_map"), (F.col("h") % 32768).alias("p"))
    maps = own.groupBy("_map").agg(F.bitmap_construct_agg("p").alias("_bits"))
    at = F.col("_bit") % 32768
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_bit", bit(column)).withColumn("_map", (F.col("_bit") / 32768).cast("int"))
    found = placed.join(F.broadcast(maps), "_map", "left")
    hit = F.coalesce((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return found.where(hit).select(*columns) if flag is None else found.select(*columns, hit.alias(flag))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col: str, folds: int, fold: int):
    """True for rows whose crc32 of the id's text leaves that remainder; such rows never teach a model."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keyed(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, rep, m, key of each distinct value of ``by``: its smallest id, its rows, and its key: that id, or a number of its own where several values have the same smallest id."""
    some = rows.groupBy(*by).agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    shared = some.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep", F.lit(True).alias("odd"))
    own = -(F.shiftrightunsigned(F.xxhash64(*by), 1)) - 1
    return some.join(shared, "rep", "left").select(*by, "rep", "m", F.when(F.col("odd"), own).otherwise(F.col("rep")).alias("key"))


def lowest(placed: DataFrame) -> DataFrame:
    """placed (key, rep, root and others) with the smallest rep of each root in its place; that is the root but where some key is a number of its own."""
    placed = written(placed, "placed")
    own = placed.groupBy("root").agg(F.min("rep").alias("low"), F.bool_or(F.col("key") != F.col("rep")).alias("odd")).where("odd").select("root", "low")
    if own.isEmpty():  # no id has several values, and no rows need to meet by their root
        return placed
    return placed.join(own, "root", "left").withColumn("root", F.coalesce("low", "root")).drop("low")
