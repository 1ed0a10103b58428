"""Removal of repeated strings against all strings."""

import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as S


def covered(raw, length):
    seen: dict = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    out = [np.zeros(len(b), bool) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                out[k][i : i + length] = True
    return out


def spans(mask):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2], edge[1::2]))


@pytest.mark.parametrize("hot", [1500, 1])
def test_equals_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK", 3000)
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(n))
    part = [say(30) for _ in range(6)]
    texts = [None, "", say(40), part[0], part[0], "x " + part[1][:90] + " y", part[2] + part[1] + " z", "ab" * 100, part[3], part[1][10:96], *(say(9) + " " + part[4][:70] + " " + say(9) for _ in range(6)), "q" * 59, "q" * 130, " " * 90, part[5][:61], part[5][:60] + "!"]
    ids = [k if k < 12 else k // 2 for k in range(len(texts))]
    ids[3] = None
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in zip(ids, texts)], "doc_id long, text string, h string, n int").repartition(3)
    got = sorted(tuple(map(str, x)) for x in S.deduplicate(docs, 60, 45, 8).collect())
    gone, told, want = covered(raw, 60), covered(raw, 45), []
    for i, b, g, t in zip(ids, raw, gone, told):
        passages = 0
        for a, e in spans(t):
            inside = [w for w in b[:e].split() if w]
            whole = [m for m in _words(b) if m[0] >= a and m[1] <= e]
            passages += len(whole) > 8
            assert inside is not None
        want.append(tuple(map(str, (i, len(b), int(g.sum()), len(spans(g)), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest(), passages, passages > 0))))
    assert got == sorted(want)
    assert any(w[5] != "0" for w in want) and any(w[5] == "0" for w in want) and any(w[2] != "0" for w in want)


def _words(b):
    out, at = [], 0
    for w in b.split():
        at = b.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def test_very_long_and_empty(spark):
    text = "abc " * 60_000
    got = S.deduplicate(spark.createDataFrame([(1, text), (2, "abc")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["n_removed"], got[0]["n_spans"], got[1]["n_removed"]) == (len(text), 1, 0)
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_starts_that_can_repeat_go_into_the_suffix_array():
    r = random.Random(4)
    say = lambda n: bytes(r.choices(range(97, 123), k=n))
    seed, shared = say(S.SEED), say(400)
    # Ten regions share their anchor alone; two share 40 bytes ahead of it and 380 behind it.
    alone = [(7, k, 1, 60, 60, say(60) + seed + say(400)) for k in range(10)]
    pair = [(7, k, 1, 60, 60, say(20) + shared[:40] + seed + shared[:380] + say(20)) for k in (10, 11)]
    found = S.candidates(alone + pair, 300, 400)
    assert {x[1] for x in found} == {10, 11}
    for length in (300, 400):
        whole = S.repeated_starts([x[5] for x in alone + pair], [x[3] for x in alone + pair], (length,))[0]
        cut = {x[1]: (x[5] + np.flatnonzero(m)).tolist() for x, m in zip(found, S.repeated_starts([x[4] for x in found], [x[3] for x in found], (length,))[0])}
        assert [np.flatnonzero(m).tolist() for m in whole] == [cut.get(x[1], []) for x in alone + pair]
        assert cut[10] and cut[10][0] == 20
    assert sum(len(x[4]) for x in found) < sum(len(x[5]) for x in alone + pair) / 5
