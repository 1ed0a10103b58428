"""Near-duplicates of texts against all pairs."""

import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.llm import common, minhash


def brute(rows, words, percent):
    """component of every row (id, text): rows of one id are one document."""
    sets = [set(minhash.shingle_hashes(t, words).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]
            if same and (rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [None if i is None else low[r] for (i, _), r in zip(rows, root)], list(map(len, sets))


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SMALL", 7)
    r = random.Random(8)
    word = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    boiler = " ".join(r.choice(word) for _ in range(60))
    base = [" ".join(r.choice(word) for _ in range(r.randint(3, 300))) for _ in range(12)]
    texts = [None, "", "  ", "one", "One", "a b", "x " * 9000, *base, *base[:4], *(b + " " + boiler for b in base[:6])]
    for n in range(60):
        w = r.choice(base).split()
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice(word)
        texts.append(" ".join(w[r.randint(0, 2) :]))
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    rows += [(rows[8][0], base[9]), (rows[8][0], base[1]), (rows[9][0], base[2]), (7, base[3]), (7, base[4]), (None, base[0]), (None, None), (5, None), (rows[10][0], texts[10])]
    want, sizes = brute(rows, 4, 80)
    assert len(set(want)) < len(rows) - 30
    docs = spark.createDataFrame([(i, t, k, 0, 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component_id int, kept int, id int").repartition(5)
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"]), x["kept"]) for x in minhash.near_duplicates(docs, words=4).collect())
    assert got == sorted((str(i), n, str(c), i is not None and i == c) for (i, _), n, c in zip(rows, sizes, want))


def test_empty_table(spark):
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_filter_lets_all_keys_pass(spark, monkeypatch):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.lit("x").alias("_map"))
    keys = spark.range(0, 20000, 7).select((F.col("id") * 2).alias("i"))
    want = {i * 2 for i in range(0, 20000, 7) if i * 2 < 20000}
    got = {r["k"] for r in common.among(rows, "k", keys).collect()}
    assert want <= got and len(got) < len(want) + 2500
    flags = {r["k"]: r["f"] for r in common.among(rows, "k", keys, "f").collect()}
    assert len(flags) == 20000 and {k for k, f in flags.items() if f} == got
    assert common.among(rows, "k", keys.limit(0)).count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    assert want <= {r["k"] for r in common.among(rows, "k", spark.range(100000).select("id")).collect()}


def test_a_block_of_near_copies_takes_bounded_memory():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**62, 400))
    sets = [np.unique(np.concatenate([base[r.random(400) < 0.95], r.integers(0, 2**62, 20)]))[:128] for _ in range(400)]
    # All meet in the list of the first common value, each in a component of its own.
    v = int(base[0])
    rows = {"v": v, "p": 0, "q": 0, "x": 0, "id": np.arange(400), "c": np.arange(400), "n": 400, "t": 70, "sketch": sets, "keys": [np.unique(np.append(s[:40], v)) for s in sets]}
    tracemalloc.start()
    found = minhash.compared(pd.DataFrame(rows), 128, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = set()
    for a in range(400):
        for b in range(a + 1, 400):
            union = np.unique(np.concatenate([sets[a], sets[b]]))[:128]
            first = np.intersect1d(rows["keys"][a], rows["keys"][b])[0]
            if first == v and len(np.intersect1d(np.intersect1d(sets[a], sets[b]), union)) >= 70:
                want.add((a, b))
    assert want and set(map(tuple, found.values.tolist())) == want
    assert peak < 100e6  # 181 MB when 20,000 pairs were set side by side
