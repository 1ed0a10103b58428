"""What grows with the tables: no needless work, no hot keys, results as before."""

import re

from graphloom.functions import text as T
from graphloom.operators import graph, ontology, reasoning, rules, validate
from graphloom.plans import catalog, knowledge, views

SF = "/root/testdata/sf0.001"


def test_totals_need_no_components(spark, monkeypatch):
    def never(*_):
        raise AssertionError("components were made")

    monkeypatch.setattr(graph, "components", never)
    row = catalog.QUERIES["corpus_totals"](spark, SF).first()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    customers = orders.groupBy("o_custkey").count()
    assert row["papers"] == orders.count() and row["isolated"] == customers.where("count = 1").count()
    assert row["citation_edges"] == row["papers"] - customers.count() and row["average_degree"] == round(2 * row["citation_edges"] / row["papers"], 3)


def test_terms_are_sent_and_dealt_by_papers(spark):
    """No text is dealt by a word of its own, and rules of one paper meet where the paper is."""
    papers = spark.createDataFrame([(f"p{i}", "the ring", "We use a ring. The ring is limited by drift.") for i in range(20)], "id string, title string, abstract string")
    vocab = spark.createDataFrame([("method:ring", "method", "ring", 0), ("limitation:drift", "limitation", "drift", 0), ("technique:c", "technique", "+c+", 0)], "entity string, type string, alias string, alias_ord int")
    df = rules.rule_edges(papers, vocab, T.CUES)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["relation"], r["evidence"]) for r in df.collect()} == {("PROPOSES", "the ring"), ("USES", "We use a ring.")} and df.count() == 40
    assert "strategy=broadcast" in plan
    texts = spark.createDataFrame([(1, "x +c+ y"), (2, "a+c+"), (3, "<ring>"), (4, "ring_s"), (5, "A RING!")], "id int, text string")
    assert {(r["id"], r["entity"]) for r in rules.term_matches(texts, vocab).collect()} == {(1, "technique:c"), (3, "method:ring"), (5, "method:ring")}


def test_limitation_reports_are_not_numbered(spark, monkeypatch):
    want = {tuple(r) for r in reasoning.limitations(knowledge.edges(spark, SF)).collect()}

    def never(*_):
        raise AssertionError("edges were numbered")

    monkeypatch.setattr(rules, "number", never)
    got = [tuple(r) for r in catalog.QUERIES["limitation_reports"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_an_end_of_many_edges_is_looked_up_once(spark, monkeypatch):
    """Edges are held against lost and odd ends; no edge is dealt by its target."""
    edges = spark.range(300).selectExpr("concat('paper:', id) AS source", "'USES' AS relation", "'method:hot' AS target")
    more = spark.createDataFrame([("paper:none", "USES", "method:hot"), ("paper:1", "USES", "paper:2"), ("paper:1", "ODD", "x"), (None, "USES", "method:hot")], "source string, relation string, target string")
    entities = spark.range(300).selectExpr("concat('paper:', id) AS id", "'paper' AS type").union(spark.createDataFrame([("method:hot", "method")], "id string, type string"))
    spec = spark.createDataFrame([("USES", ["paper"], ["method"], "ACTIVE")], "relation string, domain array<string>, range array<string>, status string")
    rows = edges.union(more)
    for few in (100_000, 0):
        monkeypatch.setattr(validate, "ENDS", few)
        lost = validate.unknown_endpoints(rows, entities)
        odd = validate.domain_range(rows, spec, entities)
        assert {r["location"] for r in lost.collect()} == {"paper:none|USES|method:hot", "USES|method:hot", "paper:1|ODD|x"}
        assert {(r["code"], r["location"]) for r in odd.collect()} == {("EDGE_RANGE", "paper:1|USES|paper:2"), ("EDGE_RELATION_NOT_STORABLE", "paper:1|ODD|x")}
        if few:
            for df in (lost, odd):
                plan = df._jdf.queryExecution().optimizedPlan().toString()
                assert plan.count("Join") == plan.count("strategy=broadcast") > 0


def test_entities_are_judged_in_one_pass(spark):
    rows = [("paper:a", "paper", {"title": ""}), ("paper:b", "paper", {"title": "t", "identity_status": "MAYBE"}), ("Bad", "paper", {}), ("method:m", "concept", None), ("method:d", "method", None), ("method:d", "method", None)]
    df = validate.entity_checks(spark.createDataFrame(rows, "id string, type string, attributes map<string,string>"), ontology.entities(spark))
    got = {(r["code"], r["location"]) for r in df.collect()}
    assert {("ENT_MISSING_ATTR", "paper:a|title"), ("ENT_BAD_STATUS", "paper:b|identity_status"), ("ENT_ID_FORMAT", "Bad"), ("ENT_PREFIX_MISMATCH", "method:m"), ("ENT_DUP_ID", "method:d")} <= got
    assert not [x for x in got if x[1].startswith("method:d") and x[0] != "ENT_DUP_ID"]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_dealt_by_paper_once(spark):
    lines = views.line_parts(spark, SF).collect()
    want = set()
    for r in lines:
        adjective, noun = r["p_name"].split(" ")[:2]
        brand = re.sub("[^a-z0-9]+", "_", r["p_brand"].lower())
        want |= {(f"paper:o_{r['l_orderkey']}", *x) for x in (("PROPOSES", f"method:{noun}"), ("USES", f"technique:{adjective}"), ("ADDRESSES", f"concept:{r['p_type'].lower()}"), ("ADDRESSES", f"problem:{brand}"))}
    df = views.edges(spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "collect_set" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and plan.count("collect_set") == 1


def test_degrees_read_their_edges_once(spark):
    df = graph.degrees(spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "a string, b string"))
    assert {tuple(r) for r in df.collect()} == {("a", 1), ("b", 4), ("c", 1)}
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
