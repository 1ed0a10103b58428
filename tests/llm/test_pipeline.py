"""The corpus pipeline, stage by stage, against plain restatements."""

import base64
import hashlib
import random

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_decontamination import brute as leaks
from test_minhash import brute as groups


def test_stages(spark, tmp_path):
    import tiktoken

    r = random.Random(11)
    alphabet = {"aa": "abcdefgh", "bb": "ijklmnop"}
    say = lambda x, n: " ".join("".join(r.choice(alphabet[x]) for _ in range(r.randint(2, 6))) for _ in range(n))
    items = [(k, say("aa", 14) + ". " + say("aa", 6) + ".") for k in range(5)]
    rows = [(k, say(x, 40), x) for k, x in enumerate(["aa", "bb"] * 20)]
    rows += [(50, rows[0][1], "aa"), (51, rows[1][1] + " extra", "bb"), (52, say("aa", 30) + " " + items[2][1] + " " + say("aa", 20), "aa"), (53, say("aa", 20) + " mail x.y@example.org on 2001-02-03", "aa"), (54, None, "aa"), (55, "", None), (56, "§§ 12", "bb"), (None, say("aa", 9), "aa"), (57, "zqzq xwxw " * 40, None), (3, say("bb", 30), "bb")]
    docs = spark.createDataFrame([(i, t, x, "src", len(t or ""), "own", 7) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    folder = f"{tmp_path}/sf"
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.conf.set("graphloom.pii.key", "another")
    held, out = docs, {}
    for name, stage in C.STAGES:
        held = C.written(stage(spark, held, folder), name)
        out[name] = held.collect()
        assert name == "byte_bpe" or held.columns == docs.columns
    pairs = lambda rs: sorted((x["doc_id"], x["text"]) for x in rs)
    known = [(i, t) for i, t, _ in rows if i is not None and i not in (54, 55, 56, 57)]
    assert pairs(out["language_id"]) == sorted(known) and all(x["kept"] == 7 and x["score"] == "own" for x in out["language_id"])
    comp, _ = groups(known, 5, 80)
    single = [x for x, c in zip(known, comp) if x[0] == c]
    assert pairs(out["near_dedup"]) == sorted(single) and len(single) == len(known) - 2
    clean = [x for x, hit in zip(single, leaks(items, [t for _, t in single])) if not hit]
    assert pairs(out["decontamination"]) == sorted(clean) and len(clean) == len(single) - 1
    private = {x["doc_id"]: x for x in out["pii"]}[53]
    assert "x.y@example.org" not in private["text"] and "2001-02-03" not in private["text"] and private["n_chars"] == len(private["text"])
    assert [x for x in pairs(out["pii"]) if x[0] != 53] == sorted(x for x in clean if x[0] != 53)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = sorted((x["doc_id"], len(own.encode_ordinary(x["text"])), hashlib.sha256(x["text"].encode()).hexdigest()) for x in out["pii"])
    assert sorted((x["doc_id"], x["n_tokens"], x["decoded_sha256"]) for x in out["byte_bpe"]) == want
    spark.conf.unset("graphloom.pii.key")


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert F is not None
