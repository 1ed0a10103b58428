import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontamination, langid, minhash, pii, product_quantisation, quality, suffix_dedup, token_files, toxicity

ODD = [None, "", " ", "a b.\nC d..\nE\n f\n\ng ,h\n.x y\n", "x   y  ", "\t \n", "don't we'll", "日本語 текст 𝒳" * 3, "a" * 3000, "<unk> </s> ▁x", "é² x²\nñ q\n\n r"]
KIND = "doc_id long, text string, lang string, id long, h long"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, 1, 2) for i, t in enumerate(texts)], KIND)


@pytest.fixture
def words():
    r = random.Random(3)
    return lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs(spark, ODD), path, P.PATTERN, keep_ids=True).collect():
        t = ODD[r["doc_id"]] or ""
        assert r["ids"] == e.encode_ordinary(t) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in token_files.tokenised(docs(spark, ODD), P.path("byte_bpe_50k.json")).collect()}
    for i, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.tokenised(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_suffix_array_and_removal(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 9, 100):
        s = rng.integers(1, 4, n)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    r = random.Random(2)
    part = ["".join(r.choice("abcdé ") for _ in range(900)) for _ in range(4)]
    texts = [None, "", part[0], part[0], "x" + part[1][:500] + "y", part[2] + part[1] + "z", "ab" * 600, part[3], part[1][100:498]]
    seen: dict = {}
    raw = [(t or "").encode() for t in texts]
    for k, b in enumerate(raw):
        for i in range(len(b) - 399):
            seen.setdefault(b[i : i + 400], []).append((k, i))
    for row in suffix_dedup.deduplicate(docs(spark, texts)).collect():
        b = raw[row["doc_id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if len(seen[b[i : i + 400]]) > 1:
                gone[i : i + 400] = True
        assert row["n_removed"] == gone.sum() and row["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    assert suffix_dedup.deduplicate(docs(spark, [])).count() == 0


def test_minhash_equals_brute_force(spark, words):
    base = [words(60) for _ in range(6)]
    texts = [None, "", "one", "One", "a b", *base, *base[:3]]
    for b in base * 4:
        w = b.split()
        w[len(texts) % 60] = "edited"
        texts.append(" ".join(w[len(texts) % 4 :]))
    sets = [set(minhash.shingle_hashes(t, 4).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), words=4).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * rng.uniform(0.05, 0.3, (100, 1))
    x[200:220] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [])]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in product_quantisation.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 304 and all(got[i]["n_links"] == 0 for i in range(300, 304))
    assert sum(got[i]["n_links"] for i in range(300)) >= 0.9 * want.sum() and all(got[i]["n_links"] <= want[i] for i in range(300))


def test_decontamination_equals_brute_force(spark, words):
    items = [words(30) + ". " + words(8) + "." for _ in range(20)] + [None, "?"]
    texts = [None, "", words(200), words(50) + " " + items[3] + " " + words(90), items[5].upper(), items[7][:60], words(700) + " " + items[9] + " " + items[2]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated(docs(spark, texts), bench).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [3], 4: [5], 5: [], 6: [2, 9]}
    assert not any(r["contaminated"] for r in decontamination.contaminated(docs(spark, texts), bench.limit(0)).collect())


def test_pii_is_format_preserving_and_linked(spark):
    texts = ["call +1 (017) 555-7713 or a.b@c.example.com, ip 10.1.2.3 card 4111111111111111 on 2020-02-29", "x 4111111111111111 y 31.02.2020 999.1.1.1", None, ""]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, texts), "k").collect()}
    card = got[1]["text"].split()[1]
    assert card in got[0]["text"] and card != "4111111111111111" and "31.02.2020 999.1.1.1" in got[1]["text"]
    digits = [int(c) for c in card][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert got[0]["n_pii"] == 5 and got[2]["text"] is None and got[3]["text"] == ""
    numbers = spark.range(0, 10000).select(pii.permute_digits("k", "t", F.lpad(F.col("id").cast("string"), 4, "0")).alias("p"))
    assert numbers.distinct().count() == 10000


def test_language_models(spark, words):
    r = random.Random(5)
    text = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(40))
    langs = ["xx" if i % 2 else "yy" for i in range(60)] + [None, None, None]
    texts = [text("abcde" if i % 2 else "defgh") for i in range(60)] + [None, "123 !?", text("abcde")]
    got = {x["doc_id"]: x for x in langid.identify(docs(spark, texts, langs), F.lit(True)).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(60)) and got[62]["lang_pred"] == "xx"
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (60, 61))


def test_toxicity_grammar():
    lexicon, machine = toxicity.Lexicon({"grub"}), toxicity.grammar()
    n = lambda t: dict(zip(toxicity.KINDS, lexicon.counts(t, machine)))
    assert n("you are an idiot.")["insult_target"] == 1 and n("what trash")["insult"] == 1
    assert n("not an idiot")["insult_negated"] == 1 and n("she said idiot")["insult_reported"] == 1
    assert n("I will kill you")["threat_target"] == 1 and n("a grubby day")["stem"] == 1 and sum(n(None).values()) == 0


def test_classifiers_learn(spark, words):
    good = [words(50) for _ in range(40)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    rows = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r["score"] for r in quality.quality(rows, labels, F.lit(True)).collect()}
    assert sum((q[i] >= 0.3) == (i < 40) for i in range(80)) >= 76 and all(0 <= q[i] <= 1 for i in q)
    t = toxicity.toxicity(rows, labels.limit(0), F.lit(True)).collect()
    assert len(t) == 82 and all(0 <= r["score"] <= 1 for r in t)
