import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import evaluation, graph, identity, rules, validate
from graphloom.sources import records


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, T.normalize_doi(F.col("a")), a=" https://dx.doi.org/10.1/AbC.. ") == "10.1/abc"
    assert one(spark, T.normalize_doi(F.col("a")), a="doi: ") is None
    assert one(spark, T.normalize_arxiv(F.col("a")), a="http://arxiv.org/pdf/2101.00001v3") == "2101.00001"
    assert one(spark, T.normalize_title(F.col("a")), a="Müller: A  Study!") == "muller a study"
    assert one(spark, T.slug(F.col("a")), a="--") == "x"


def test_whole_terms(spark):
    assert one(spark, T.matches(F.col("t"), F.col("a")), t="A C++ ring.", a="c++") is True
    assert one(spark, T.matches(F.col("t"), F.col("a")), t="strings", a="ring") is False
    assert one(spark, T.matches(F.col("t"), F.col("a")), t="x", a="") is False


def test_components_and_distances(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (None, 5)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in graph.components(chain).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30}
    far = graph.bounded_distance(chain.where("a IS NOT NULL"), spark.createDataFrame([(5,)], "seed long"), 2)
    assert {(r["id"], r["distance"]) for r in far.collect()} == {(5, 0), (4, 1), (6, 1), (3, 2), (7, 2)}
    assert graph.components(chain.limit(0)).count() == 0


def test_ambiguous_group_does_not_merge(spark):
    rows = spark.createDataFrame([(1, "a", "k", None), (2, "b", "k", None), (3, None, "m", None), (4, "c", "m", None)], "rec_ord long, doi string, fbk string, arxiv string")
    grouped = identity.exact_groups(rows, F.array("doi", "arxiv"))
    done = {r["rec_ord"]: r["cand"] for r in identity.resolve(grouped, ["doi"]).collect()}
    assert done == {1: 1, 2: 2, 3: 3, 4: 3}


def greedy(rows, quotas, target):
    picked, rows = [], sorted(rows, key=lambda r: (-r[2], r[0]))
    n = dict.fromkeys({r[1] for r in rows}, 0)
    for r in rows:
        if n[r[1]] < quotas.get(r[1], (0, None))[0]:
            picked.append(r[0])
            n[r[1]] += 1
    for relaxed in (False, True):
        for r in rows:
            hi = quotas.get(r[1], (0, None))[1]
            if len(picked) < target and r[0] not in picked and (relaxed or hi is None or n[r[1]] < hi):
                picked.append(r[0])
                n[r[1]] += 1
    return set(picked)


@pytest.mark.parametrize("target", [3, 7, 12])
def test_quota_selection_is_the_greedy_one(spark, target):
    rows = [(f"p{i}", "abc"[i % 3] if i % 5 else "unknown", float(i * 7 % 11)) for i in range(16)]
    quotas = {"a": (1, 2), "b": (2, 2), "c": (0, 5)}
    got = identity.quota_selection(spark.createDataFrame(rows, "id string, bucket string, score double"), spark.createDataFrame([(k, *v) for k, v in quotas.items()], "bucket string, lo int, hi int"), target)
    assert {r["id"] for r in got.collect()} == greedy(rows, quotas, target)


def test_rules_fire_on_cue_and_title(spark):
    papers = spark.createDataFrame([("p1", "On rings", "Rings are old. We propose a ring method."), ("p2", "A ring study", "Nothing."), ("p3", "x", "A ring lies here.")], "id string, title string, abstract string")
    vocab = spark.createDataFrame([("method:ring", "method", "ring", 1)], "entity string, type string, alias string, alias_ord int")
    got = {(r["source"], r["relation"]) for r in rules.rule_edges(papers, vocab, T.CUES).collect()}
    assert ("p1", "PROPOSES") in got and ("p2", "PROPOSES") in got and not any(s == "p3" for s, _ in got)


def test_numbering_has_no_gaps(spark):
    rows = spark.range(500).select(F.col("id").alias("k"))
    assert [r["edge_id"] for r in rules.number(rows, ["k"]).orderBy("k").collect()] == [f"edge_{i:04d}" for i in range(1, 501)]


def test_violations(spark):
    edges = spark.createDataFrame([("paper:a", "USES", "method:b"), ("paper:a", "USES", "method:b"), ("paper:z", "USES", "method:b")], "source string, relation string, target string")
    ids = spark.createDataFrame([("paper:a",), ("method:b",)], "id string")
    assert [r["location"] for r in validate.unknown_endpoints(edges, ids).collect()] == ["paper:z|USES|method:b"]
    found = validate.duplicates(edges, ["source", "relation", "target"], "EDGE_DUP_TRIPLE")
    with pytest.raises(ValueError):
        validate.assert_valid(found)


def test_greedy_matching_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.7), (1, "b", "y", 0.1)], "proposal long, gold string, system string, similarity double")
    assert {(r["gold"], r["system"]) for r in evaluation.greedy_matching(pairs, 0.05).collect()} == {("a", "x"), ("b", "y")}


def test_openalex_and_atom(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.48550/arXiv.2101.1", "title": "t", "publication_year": 2021, "referenced_works": ["a", "b"], "authorships": [{"author": {"display_name": "A B"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]}')
    r = records.read_openalex(spark, str(tmp_path / "w.json")).first()
    assert (r["source_id"], r["abstract"], r["arxiv_id"], r["reference_count"]) == ("W1", "a b a", "2101.1", 2)
    (tmp_path / "f.atom").write_text('<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  b</title><summary> s </summary><published>2021-01-02T00:00:00Z</published><author><name>X Y</name></author></entry></feed>')
    r = records.read_atom(spark, str(tmp_path / "f.atom")).first()
    assert (r["arxiv_id"], r["title"], r["year"], r["publication_date"], r["authors"]) == ("2101.00001", "A b", 2021, "2021-01-02", ["X Y"])


def test_registry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
