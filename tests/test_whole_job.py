"""Queries and operators against the whole job, by brute force."""

import math
import re
from collections import Counter

import numpy as np

from graphloom.functions import text as T
from graphloom.operators import evaluation, identity, rules
from graphloom.plans import catalog, views

SF = "/root/testdata/sf0.001"


def top(scores, k=10):
    return [i for _, i in sorted((-s, i) for i, s in scores.items())[:k]]


def ranked(rows, key):
    out = {}
    for r in sorted(rows, key=lambda r: (r[key], r["rank"])):
        out.setdefault(r[key], []).append(r["id"])
    return out


def test_cosine_asks_with_every_twentieth_row(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "MEMBERS", 60)
    monkeypatch.setattr(evaluation, "QUERIES", 7)
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = ranked(catalog.QUERIES["cosine_top10"](spark, SF).collect(), "query_id")
    assert set(got) == {i for i in rows if i % 20 == 0} and len(got) > 5
    for q, found in got.items():
        s = {i: float(v @ rows[q] / math.sqrt((v @ v) * (rows[q] @ rows[q]))) for i, v in rows.items() if i != q}
        assert np.allclose([s[i] for i in found], [s[i] for i in top(s)], atol=1e-12)


def test_cosine_of_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(30, [1e200, 2e200]), (31, [0.0, 0.0]), (32, None), (33, [1.0, float("nan")]), (34, [1.0]), (35, [2.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = ranked(evaluation.cosine_top(v, v, 3).collect(), "query_id")
    assert got == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], **{i: [0, 1, 2] for i in range(3, 31)}, 34: [35], 35: [34]}


def test_bm25_asks_with_every_twentieth_document(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "MEMBERS", 60)
    monkeypatch.setattr(evaluation, "QUERIES", 7)
    docs = {r["doc_id"]: re.findall("[a-z0-9]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df, mean = Counter(w for ws in docs.values() for w in set(ws)), sum(map(len, docs.values())) / len(docs)
    tf = {i: Counter(ws) for i, ws in docs.items()}
    got = ranked(catalog.QUERIES["bm25_top10"](spark, SF).collect(), "request_id")
    assert set(got) == {i for i in docs if i % 20 == 0 and docs[i]} and len(got) > 4
    for q, found in got.items():
        s = {}
        for i, n in tf.items():
            if common := sorted(set(docs[q]) & set(n)):
                s[i] = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for w in common)
        assert np.allclose([s[i] for i in found], [s[i] for i in top(s)], rtol=1e-9)
        assert all(a < b for a, b in zip(found, found[1:]) if docs[a] == docs[b])


def test_score_has_logarithms_and_parts(spark):
    rows = spark.createDataFrame([("a", 2, 99, 3, 4, 2001), ("b", None, None, None, None, None)], "id string, n_seeds int, citation_count long, reference_count long, degree long, year int")
    got = {r["id"]: r for r in identity.score_parts(rows, 2001).collect()}
    assert math.isclose(got["a"]["score"], 20 + math.log1p(99) + 0.5 * math.log1p(3) + 8 + 1)
    assert list(got["a"]["parts"].asDict()) == list(identity.SCORE) and got["a"]["parts"]["seed_hits"] == 20.0
    assert got["b"]["score"] == 0.0


def test_selection_goes_by_that_score(spark):
    degree = Counter(x for r in views.cites(spark, SF).collect() for x in r)
    want = {r["id"]: 10 * (r["seed"] is not None) + math.log1p(r["citation_count"]) + 0.5 * math.log1p(r["reference_count"]) + 2 * degree[r["id"]] + (r["year"] >= views.NOW) for r in views.paper(spark, SF).collect()}
    got = {r["id"]: r for r in catalog.QUERIES["candidate_score_parts"](spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[i]["score"] - want[i]) < 1e-8 and abs(sum(got[i][n] for n in identity.SCORE) - want[i]) < 1e-8 for i in want)
    assert all(abs(r["score"] - want[r["id"]]) < 1e-8 for r in catalog.QUERIES["quota_selection"](spark, SF).collect())


def test_limitations_of_all_lines(spark):
    lines = {(f"paper:o_{r['l_orderkey']}", "method:" + r["p_name"].split(" ")[1], r["l_linenumber"]) for r in views.line_parts(spark, SF).collect()}
    assert max(n for *_, n in lines) > 2
    got = [tuple(r) for r in catalog.QUERIES["limitations_report"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, m, f"limitation:l{n}") for p, m, n in lines}
    found = {r["location"] for r in catalog.QUERIES["validate_attribution"](spark, SF).collect()}
    assert found == {f"{m}|REPORTS_LIMITATION|limitation:l{n}" for _, m, n in lines if n % 2 == 0}


def test_limitation_edges_need_label_method_and_cue(spark):
    texts = ["We propose a ring. The ring is limited under noise.", "However, the loop is limited in Noise.", "A ring meets noise.", "The ring is limited. Noise is a challenge.", "A ring is limited under static.", None]
    papers = spark.createDataFrame([(f"p{i}", "x", t) for i, t in enumerate(texts)], "id string, title string, abstract string")
    vocab = [("method:ring", "method", "ring", 1), ("method:ring", "method", "loop", 2), ("limitation:noise", "limitation", "noise", 1), ("limitation:noise", "limitation", "static", 2)]
    rows = rules.limitation_edges(papers, spark.createDataFrame(vocab, "entity string, type string, alias string, alias_ord int"), T.CUES).collect()
    assert {(r["source_paper"], r["source"], r["target"], r["attribution"], r["evidence"]) for r in rows} == {
        ("p0", "method:ring", "limitation:noise", "SELF_REPORTED", "The ring is limited under noise."), ("p1", "method:ring", "limitation:noise", "THIRD_PARTY", "However, the loop is limited in Noise."),
    }
    assert len(rows) == 2
