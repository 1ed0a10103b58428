"""Scalar functions against plain Python."""

import random
import unicodedata

from pyspark.sql import functions as F

from graphloom.functions import text as T


def test_fold_is_the_compatibility_decomposition(spark):
    chars = [chr(c) for c in [*range(0x250, 0x370), *range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0x2460, 0x2500), *range(0x3300, 0x33FF), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D500), 0x1F100, 0x1F600]]
    texts = ["Dvořák Žižek Łódź ﬁne", "plain", "", "é ½ Ⅻ ㎏ 𝒳y 😀z", *("a" + c + "b" for c in chars)]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold_latin(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == dict(enumerate(want))
    assert want[0] == "dvorak zizek odz fine"


def test_rounding_is_by_the_exact_value(spark):
    r = random.Random(1)
    values = [0.28125, 0.70005, 0.5, 0.00005, 0.00015, 0.12345, 1.0, 0.0, -0.28125, -0.70005, 2.675, 0.03125, 0.15625]
    values += [r.random() for _ in range(3000)] + [r.randrange(20001) / 20000 for _ in range(3000)] + [r.randrange(2049) / 2048 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.round_half_even(F.col("v"), 4).alias("a"), T.round_half_even(F.col("v"), 3).alias("b")).collect()
    assert all(x["a"] == round(x["v"], 4) and x["b"] == round(x["v"], 3) for x in rows)


def test_unknown_terms(spark):
    rows = [(1, "Wanting Zebra alpha zebra-like ring-shaped things", ["ring"], False), (2, "of it", None, True), (3, "  ", None, True), (4, "alpha beta", ["alpha"], False), (5, "x" * 90, ["x"], True), (6, None, None, True)]
    got = {r["i"]: r["u"] for r in spark.createDataFrame(rows, "i int, t string, p array<string>, n boolean").select("i", T.unknown_terms(F.col("t"), F.col("p"), F.col("n")).alias("u")).collect()}
    assert got[1] == ["Zebra", "alpha", "ring-shaped", "things", "zebra-like"] and got[2] == ["of it"] and got[3] == ["empty_input"] and got[4] == [] and got[5] == ["x" * 90]


def test_novelty_and_cache_names(spark):
    rows = spark.createDataFrame([("This proposal is truly novel.",), ("Useful because it has typed edges",), ("no prior work exists",), ("a novel method",)], "t string")
    assert [r["x"] for r in rows.select(T.claims_novelty(F.col("t")).alias("x")).collect()] == [True, False, True, False]
    assert [r["x"] for r in spark.createDataFrame([("Agentic memory: systems!",), ("***",)], "t string").select(T.cache_name(F.col("t")).alias("x")).collect()] == ["agentic_memory_systems", "query"]
