"""Threshold search of the adapter that maps a ranked score to a positioning label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("WELL_EXPLORED", "PARTIALLY_EXPLORED", "UNDERREPRESENTED", "UNKNOWN")


def label_of(score: Column, lo: Column, hi: Column) -> Column:
    """Ordinal thresholds: from ``hi`` on, from ``lo`` on, above zero, else; a null score is unknown."""
    return F.when(score >= hi, LABELS[0]).when(score >= lo, LABELS[1]).when(score > 0, LABELS[2]).otherwise(LABELS[3])


def grid_search(dev: DataFrame, lows: Sequence[float], highs: Sequence[float]) -> DataFrame:
    """Per system the cell with the best macro-F1 over its gold classes (system, lo, hi, macro_f1); of equal cells the first.

    dev: system, gold, score. Every system is fitted on its own rows over the same cells, those with lo < hi. Rows are repeated once
    per cell and summed into confusion counts before any shuffle, so a shuffle carries cells x classes and no rows.
    """
    cells = [(lo, hi) for lo in lows for hi in highs if lo < hi]
    every = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for i, (lo, hi) in enumerate(cells)])
    rows = dev.select("system", "gold", "score", F.explode(every).alias("g")).select("system", "gold", "g.*", label_of(F.col("score"), F.col("g.lo"), F.col("g.hi")).alias("predicted"))
    counts = rows.groupBy("system", "cell", "lo", "hi", "gold", "predicted").agg(F.count("*").alias("n"))
    # Each count tells of its gold class and of its predicted class.
    sides = counts.select("system", "cell", "lo", "hi", F.explode(F.array(F.struct(F.col("gold").alias("class"), F.col("n").alias("support"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("said")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("said")))).alias("s")).select("system", "cell", "lo", "hi", "s.*")
    per = sides.groupBy("system", "cell", "lo", "hi", "class").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("said").alias("said")).where("support > 0")
    f1 = per.groupBy("system", "cell", "lo", "hi").agg(F.round(F.avg(F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("said"))), 9).alias("macro_f1"))
    best = Window.partitionBy("system").orderBy(F.desc("macro_f1"), "cell")
    return f1.withColumn("r", F.row_number().over(best)).where("r = 1").select("system", "lo", "hi", "macro_f1")
