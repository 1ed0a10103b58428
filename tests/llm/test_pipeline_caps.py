"""The pipeline's stages where a bound of lengths, letters, turns or rounds was met."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from graphloom.llm import langid, pii
from graphloom.operators import graph
from test_minhash import brute as groups


def test_pii_of_any_length_and_name(spark):
    values = {1: "a" * 65 + "@example.org", 2: "x@" + "b" * 64 + ".org", 3: "x@mail." + "b" * 70 + ".org", 4: "x.y@" + "a." * 20000 + "org", 5: "hunterhunter", 6: "hunterhunters"}
    texts = {i: f"write to {v} soon" for i, v in values.items()} | {5: f'my password = "{values[5]}" soon', 6: f"my passwd:'{values[6]}' soon"}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in C.pseudonymise(spark, docs, "").collect()}
    assert all(re.fullmatch(r"write to u[0-9a-f]{16}@mail\.invalid soon", got[i]) for i in (1, 2, 3, 4))
    assert re.fullmatch(r'my password = "[0-9a-f]{12}" soon', got[5]) and re.fullmatch(r"my passwd:'[0-9a-f]{13}' soon", got[6])


def test_pii_dates_walk_to_the_end(spark, monkeypatch):
    days = [f"{y}-{m}-{d}" for y in range(1900, 1912) for m in range(1, 10) for d in range(10, 29)]
    docs = spark.createDataFrame(list(enumerate(days)), "doc_id long, text string")
    dates = lambda: [r["text"] for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    want = dates()
    assert len(set(want)) == len(days) and sum(a == b for a, b in zip(want, days)) < 5
    monkeypatch.setattr(pii, "STEPS", 1)
    assert dates() == want
    assert pii.NO_DAYS == 400 * 279 - sum((29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28) + 31 * 5 + 30 * 3 for y in range(1800, 2200))


def test_languages_whose_letters_lie_beyond_the_basic_plane(spark):
    # These two letters fell on one code.
    a, b = 0x20000, 0x20000 + 6400
    rows = [(i, chr((a, b)[i % 2]) * 6, ("aa", "bb")[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("aa", "bb")[r["doc_id"] % 2] for r in langid.identify(docs, F.lit(True)).collect())
    assert {r["doc_id"] for r in C.language_id(spark, docs, "").collect()} == set(range(40))
    units = lambda t: list(memoryview(t.encode("utf-16-le")).cast("H"))
    assert langid.letters("X𐐀😀é 1").tolist() == [32, *units("x𐐨"), 32, *units("é"), 32]


def test_groups_that_take_more_rounds(spark, monkeypatch):
    path = [*range(1, 40), 0]
    links = spark.createDataFrame(list(zip(path, path[1:])) + [(100, 101), (102, 101), (103, 103), (None, 5)], "a long, b long").repartition(16)
    got = {r["id"]: r["component_id"] for r in graph.components(links, 4).collect()}
    assert got == dict.fromkeys(range(40), 0) | dict.fromkeys((100, 101, 102), 100)
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [((i + 1) % 12, " ".join(words[4 * i : 4 * i + 60])) for i in range(12)]  # each is near to the next one only
    comp, _ = groups(rows, 5, 80)
    assert set(comp) == {0}
    monkeypatch.setattr(graph.components, "__defaults__", (1,))
    docs = spark.createDataFrame([(i, t, "aa") for i, t in rows], "doc_id long, text string, lang string")
    assert [x["doc_id"] for x in C.near_dedup(spark, docs, "").collect()] == [0]
