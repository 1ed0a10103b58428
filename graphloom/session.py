"""Session defaults and the storage that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with the settings that the operators count on: UTC, adaptive execution and splitting of skewed joins."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=fixed | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temp folder where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files when it ends; a write's own plan is never run again, so nothing can miss them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    The shuffle files of the write are removed at its end; without that, they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave, once all that was made from it is written itself."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that fresh_path gave and that no reader needs any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
