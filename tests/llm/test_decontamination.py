"""Benchmark decontamination against a search of every passage for every item."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination as D


@pytest.fixture
def case():
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 3))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, f"{say(r.randint(4, 20))}. {say(r.randint(2, 9))}.") for k in range(40)] + [(99, None), (None, "lost item"), (98, " ?! "), (97, "two words"), (5, say(12))]
    texts = [None, "", "...", say(400), items[3][1] * 3, "x " * 5000 + items[7][1].upper() + " y" * 5000, say(90) + items[2][1] + say(70) + items[11][1], items[9][1].split(".")[0], "two words", "Two Words and more"]
    for _ in range(40):  # edited items: some words exchanged
        w = f"{say(30)} {r.choice(items[:40])[1]} {say(30)}".split()
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    return items, texts


def brute(items, texts, n=5, overlap=0.8, threshold=0.7):
    kept = [(i, t, D.words_of(t)) for i, t in items if i is not None and D.words_of(t)]
    df = {}
    for _, _, w in kept:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean, step = np.mean([len(w) for _, _, w in kept]), max(n, max(len(w) for _, _, w in kept))
    out = []
    for text in texts:
        words, found = D.words_of(text), set()
        for p in range(0, len(words), step):
            inside = words[p : p + 2 * step]
            for i, t, w in kept:
                weight = {x: np.log(1 + (len(kept) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
                if sum(weight[x] for x in set(inside) if x in weight) < (threshold - 1e-9) * sum(weight.values()):
                    continue
                s = [x for x in D.re.split(r"(?<=[.!?])\s+|\n+", t) if D.words_of(x)]
                a = D.words_of(s[-1])
                q = D.words_of(" ".join(s[:-1])) or a
                share = []
                for part in (w, q, a):
                    k = min(n, len(part))
                    own = D.shingles(part, k)
                    share.append(len(own & D.shingles(inside, k)) / len(own))
                if share[0] >= overlap or min(share[1:]) >= overlap:
                    found.add(i)
        out.append(sorted(found))
    return out


def test_equals_search_of_all_passages(spark, case):
    items, texts = case
    want = brute(items, texts)
    assert sum(map(bool, want)) > 15 and not all(want)
    docs = spark.createDataFrame([(k, t, "own", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, item_ids string, score double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(docs, bench, carry=("text", "score")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == dict(enumerate(want))
    assert all(r["contaminated"] == bool(r["item_ids"]) and r["text"] == texts[r["doc_id"]] and r["score"] == 1.0 for r in got)


def test_shards_change_nothing(spark, case, monkeypatch):
    items, texts = case
    docs = spark.createDataFrame([(k // 2 if k < 8 else None if k == 8 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((str(r["doc_id"]), r["item_ids"], round(r["best_score"], 9), r["best_overlap"]) for r in D.contaminated(docs, bench).collect())
    one = rows()
    monkeypatch.setattr(D, "SHARD_BYTES", 700)
    assert rows() == one and len(one) == len(texts)


def test_wand_skips_blocks(case):
    items, _ = case
    many = [(k, " ".join(f"w{k}x{j % 7} c{j}" for j in range(12))) for k in range(200)]
    index = D.Index(many, 5)
    assert [h[0] for h in index.search("noise " * 30 + many[17][1], 0.7, 0.8)] == [17]
    bounded, opened, scored = index.work
    assert opened < 0.1 * bounded and scored <= opened * D.BLOCK


def test_empty_tables(spark, case):
    items, texts = case
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(docs.limit(0), bench).count() == 0
    none = D.contaminated(docs, bench.limit(0))
    assert none.count() == len(texts) and none.where("contaminated").isEmpty()
    assert none.where(F.col("best_score") > 0).isEmpty()
