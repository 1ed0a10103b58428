"""Training-data operators against the whole job, by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid, pii, product_quantisation, quality


def test_vectors_of_rare_lengths_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(product_quantisation, "LENGTHS", 2)
    monkeypatch.setattr(product_quantisation, "QUERIES", 3)
    r = random.Random(5)
    rows = [(100 * dim + i, [1.0 + r.random() * 0.6 * (i % 3) for _ in range(dim)]) for dim, many in ((8, 12), (5, 10), (3, 8), (4, 7), (6, 2)) for i in range(many)]
    rows += [(900, [1e200, 1e200, 1e200]), (901, [1e-300, 1e-300, 1e-300]), (902, [0.0, 0.0, 0.0]), (903, [float("inf"), 1.0, 1.0])]
    got = {x["vec_id"]: x for x in product_quantisation.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.97).collect()}
    unit = {i: np.array(v) / max(v) / np.linalg.norm(np.array(v) / max(v)) for i, v in rows if i < 902}
    near = {i: [j for j in unit if j != i and len(unit[j]) == len(v) and v @ unit[j] >= 0.97] for i, v in unit.items()}
    assert {i: got[i]["n_links"] for i in got} == {i: len(near.get(i, [])) for i, _ in rows}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[i]["component_id"] == min(seen)
    assert near[900] and near[901] and len(got) == len(rows)


def test_secrets_of_any_length(spark):
    secrets = {n: "aB3" * (n // 3) + "x" * (n % 3) for n in (8, 64, 65, 200, 201, 257, 5000)}
    rows = [(n, f'set token = "{s}" here') for n, s in secrets.items()]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for n, s in secrets.items():
        assert len(got[n]) == len(f'set token = "{s}" here') and s not in got[n]
        assert got[n].startswith('set token = "') and got[n].endswith('" here')


def test_quality_learns_from_every_row_and_pair(spark):
    r = np.random.default_rng(3)
    x = r.random((9000, len(quality.NAMES)))
    y = np.where(x[:, 0] + 0.3 * r.standard_normal(9000) > 0.7, 1, 0)
    y[::50] = 2
    taught = spark.createDataFrame([(f, int(k)) for f, k in zip(x.tolist(), y)], "f array<double>, y int").repartition(5).cache()
    # Every row counts in the moments, whatever its label.
    model = quality.fit(taught)
    assert np.allclose(model.mean, x.mean(0), atol=1e-6) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-6)
    worth = model.worth(x)
    assert abs(model.at - np.quantile(worth, np.mean(y == 0), method="midpoint")) < 1e-12 and abs(model.steep - 2 / worth.std()) < 1e-4
    # The slope is that of all pairs, one by one.
    few = np.arange(1200)
    z, good, bad = model.wide(x), few[y[few] == 1], few[y[few] == 0]
    apart = (z[good][:, None] - z[bad][None]).reshape(-1, z.shape[1])
    want = -(apart / (1 + np.exp(apart @ model.weights))[:, None]).mean(0)
    part = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in few], "f array<double>, y int")
    assert np.abs(quality.slope(part, model) - want).max() < 1e-5
    assert quality.fit(taught.repartition(3)).weights.tolist() == model.weights.tolist()


def test_quality_threshold_is_of_every_row(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcD7#.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(3, 40)))
    texts = [text() for _ in range(10000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [int(t.count("#") * 7 < len(t) + r.randint(-9, 9)) for t in texts]
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, quality int")
    got = quality.quality(docs, labels, F.lit(True), threshold=0.3)
    assert got.where("score < 0.3").count() == kinds.count(0)


def test_languages_of_grams_beyond_the_model(spark, monkeypatch):
    r = random.Random(12)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "abcdhij", "dd": "𐐨𐐩𐐪a"}
    say = lambda x: " ".join("".join(r.choice(alphabets[x]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9)))
    rows = [(i % 150, say(x), x if i % 3 else None) for i, x in enumerate(list(alphabets) * 40)] + [(900, None, "aa"), (901, "12 !", "aa"), (902, "zzzz xxxx qqqq " * 30, None), (None, say("bb"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    judged = lambda: sorted(((x["doc_id"] or -1, x["text"] or "", x["lang_pred"], x["rejected"], x["score"], x["entropy"] or 0.0) for x in langid.identify(docs, F.lit(True), carry=("text",)).collect()))
    want = judged()
    for most in (300, 40, 1):
        monkeypatch.setattr(langid.fit, "__defaults__", ("text", "lang", most))
        got = judged()
        assert [x[:4] for x in got] == [x[:4] for x in want]
        assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-4, atol=1e-6)


def test_more_than_64_languages(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + 40 * i) * 3 + chr(0x4E01 + 40 * i) * 4, f"l{i:03}") for i in range(90)], "doc_id long, text string, lang string")
    assert all(x["lang_pred"] == f"l{x['doc_id']:03}" for x in langid.identify(docs, F.lit(True)).collect())


def test_pipeline_keeps_the_same_documents_of_a_model_beyond_its_size(spark, monkeypatch):
    r = random.Random(13)
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop"}
    say = lambda x: " ".join("".join(r.choice(alphabets[x]) for _ in range(r.randint(2, 6))) for _ in range(40))
    rows = [(k, say(x), x, "src", k * 3) for k, x in enumerate(["aa", "bb"] * 30)] + [(70, "zqzq xwxw " * 40, None, "odd", 1), (71, None, "aa", "odd", 2), (72, "12 !", None, "odd", 3), (None, say("aa"), "aa", "odd", 4), (3, say("bb"), "bb", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score long").repartition(3)
    kept = lambda: sorted(map(repr, map(tuple, corpus_pipeline.language_id(spark, docs, "").collect())))
    want = kept()
    assert want == sorted(repr(x) for x in rows if x[0] is not None and x[3] != "odd")
    for most in (200, 1):
        monkeypatch.setattr(langid.fit, "__defaults__", ("text", "lang", most))
        assert kept() == want
