"""From records over HTTP to a validated state and its analysis, on small files."""

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import validate
from graphloom.plans import corpus
from graphloom.sinks import state as S
from graphloom.sources import fetch, files, records

ATOM = """<feed xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>Episodic
  memory</title><summary>We propose episodic memory. We use rehearsal.</summary><published>2024-01-02T00:00:00Z</published><author><name>A  B</name></author>
  <link title="journal_ref" href="J 1"/></entry></feed>"""
WORKS = {
    "results": [
        {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.48550/arXiv.2101.00001", "display_name": "Episodic memory", "publication_year": 2024, "referenced_works": ["https://openalex.org/W2", "https://openalex.org/W9"], "authorships": [{"author": {"display_name": "A B"}}], "cited_by_count": 5, "abstract_inverted_index": {"agents": [1], "Old": [0]}},
        {"id": "https://openalex.org/W2", "doi": "https://doi.org/10.1/B", "display_name": "Drift", "publication_year": 2020, "referenced_works": [], "authorships": [], "abstract_inverted_index": None, "ids": {"doi": "x"}},
    ]
}


def opener(log):
    def get(address, headers, seconds):
        log.append(address)
        if "arxiv" in address:
            return (200, {}, ATOM) if "memory" in urllib.parse.unquote(address) else (200, {}, "<feed></feed>")
        if "/works/W9" in address:
            return 404, {}, "gone"
        if len(log) < 3:
            return 429, {"retry-after": "7"}, ""
        return 200, {}, json.dumps(WORKS)

    return get


def test_waits_and_errors():
    waits, log = [], []
    answers = iter([(500, {}, ""), (429, {"retry-after": "90"}, ""), (429, {"retry-after": "soon"}, ""), (200, {}, "ok")])
    assert fetch.fetch("http://x", {"a": 1}, opener=lambda *a: log.append(a[0]) or next(answers), sleep=waits.append) == "ok"
    assert waits == [1.0, 60.0, 4.0] and log[0] == "http://x?a=1"
    with pytest.raises(fetch.FetchError, match="404"):
        fetch.fetch("http://x", {}, opener=lambda *a: (404, {}, "no"), sleep=waits.append)

    def broken(*a):
        raise OSError("down")

    with pytest.raises(fetch.FetchError, match="down"):
        fetch.fetch("http://x", {}, opener=broken, sleep=lambda s: None, tries=2)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Acquired, normalised, selected and built once."""
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    log = []
    manifest = fetch.acquire(spark, ["memory", "other"], ["arxiv", "openalex", "semantic_scholar"], folder, expand=5, opener=opener(log), sleep=lambda s: None)
    files.put_text(spark, f"{folder}/acquisition.json", "".join(r["value"] + "\n" for r in S.canonical(manifest).collect()))
    vocabulary = {
        "entries": [
            {"id": "method:episodic", "label": "Episodic memory", "aliases": ["episodic store"], "approval": {"status": "APPROVED", "approved_by": "me", "approved_on": "2026-01-01"}},
            {"id": "technique:rehearsal", "label": "rehearsal", "approval": {"status": "APPROVED", "approved_by": "me", "approved_on": "2026-01-01"}},
            {"id": "concept:drift", "label": "Drift", "approval": {"status": "APPROVED", "approved_by": "me", "approved_on": "2026-01-01"}},
            {"id": "concept:draft", "label": "agents", "approval": {"status": "DRAFT"}},
        ],
        "ambiguous_terms": [],
    }
    files.put_text(spark, f"{folder}/vocabulary.yaml", json.dumps(vocabulary))
    assert cli.main(["corpus", "normalize", "--folder", folder], spark) == 0
    assert cli.main(["corpus", "select", "--folder", folder, "--target-size", "5"], spark) == 0
    assert cli.main(["build", "--folder", folder, "--vocabulary", f"{folder}/vocabulary.yaml", "--out", f"{folder}/state"], spark) == 0
    return folder, manifest.collect()


def test_acquisition_and_pool(spark, built):
    folder, manifest = built
    status = {(r["query"], r["provider"]): (r["status"], r["record_count"]) for r in manifest}
    assert status["memory", "arxiv"] == ("ok", 1) and status["other", "arxiv"] == ("ok", 0) and status["memory", "openalex"] == ("ok", 2)
    assert status["memory", "semantic_scholar"] == ("missing_api_key", 0)
    pool = {r["canonical_id"]: r for r in spark.read.parquet(f"{folder}/pool/candidates").collect()}
    one = pool["arxiv:2101.00001"] if "arxiv:2101.00001" in pool else pool["doi:10.48550/arxiv.2101.00001"]
    assert len(pool) == 2 and sorted(one["sources"]) == ["arxiv", "openalex"] and one["seed_queries"] == ["memory", "other"]
    assert [r["source_paper_id"] for r in one["references"]] == ["W2", "W9"] and one["venue"] == "J 1" and one["authors"] == ["A B"]
    report = json.loads(files.get_text(spark, f"{folder}/normalization_report.json"))
    assert (report["raw_records"], report["candidate_groups"]) == (5, 2)
    assert "papers" in json.loads(files.get_text(spark, f"{folder}/manifest.json")) and "# Corpus quality" in files.get_text(spark, f"{folder}/quality.md")


def test_state_is_valid_until_it_is_changed(spark, built, tmp_path):
    folder, _ = built
    assert cli.main(["validate", f"{folder}/state"], spark) == 0
    parts, manifest = S.load_state(spark, f"{folder}/state")
    assert {r["relation"] for r in parts["edges"].collect()} == {"CITES", "PROPOSES", "ADDRESSES", "USES"} and manifest["counts"]["ambiguities"] == 0
    other = f"file://{tmp_path}/state"
    again = S.save_state(parts, other, cli.VERSIONS, {"created_utc": "later"})
    assert again["content_sha256"] == manifest["content_sha256"]
    files.put_text(spark, f"{other}/manifest.json", S.dumps(again | {"content_sha256": "0" * 64}))
    assert cli.main(["validate", other], spark) == 1
    files.put_text(spark, f"{other}/edges/part-x.txt", '{"edge_id": 7, broken')
    with pytest.raises(files.StateCorrupt):
        S.load_state(spark, other)
    assert cli.main(["validate", f"file://{tmp_path}/nothing"], spark) == 2


def test_analysis_and_inspection(spark, built, capsys):
    folder, _ = built
    common = ["analyze", "--state", f"{folder}/state", "--vocabulary", f"{folder}/vocabulary.yaml", "--proposal", "An episodic  store with zebras against drift"]
    assert cli.main([*common, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [x["entity"] for x in out["matched"]] == ["concept:drift", "method:episodic"] and out["unknown"] == ["against", "zebras"]
    assert {w["paper"] for w in out["prior_work"]} == {e["paper"] for e in out["evidence"]} and out["position"]["label"] != "UNKNOWN"
    assert {e["basis"] for e in out["evidence"]} == {"RULE_DERIVED"} and all(e["edge_id"].startswith("edge_") and e["fragment"] for e in out["evidence"])
    assert cli.main([*common, "--verbose"], spark) == 0 and "# prior work" in capsys.readouterr().out
    assert cli.main(["inspect", f"{folder}/state", "--entity", "method:episodic", "--neighbors", "method:episodic", "--stats"], spark) == 0
    assert "PROPOSES" in capsys.readouterr().out


def test_schemas_docs_and_seals(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert cli.main(["schemas", "--folder", folder, "--check"], spark) == 1 and cli.main(["schemas", "--folder", folder], spark) == 0 and cli.main(["schemas", "--folder", folder, "--check"], spark) == 0
    assert cli.main(["docs", "--folder", folder, "--check"], spark) == 1 and cli.main(["docs", "--folder", folder], spark) == 0 and cli.main(["docs", "--folder", folder, "--check"], spark) == 0
    assert cli.main(["seal", f"{folder}/ontology.md"], spark) == 0 and cli.main(["seal", f"{folder}/ontology.md", "--verify"], spark) == 0
    files.put_text(spark, f"{folder}/ontology.md", "x")
    assert cli.main(["seal", f"{folder}/ontology.md", "--verify"], spark) == 1 and cli.main(["seal", f"{folder}/no.md"], spark) == 2


def test_identity_rules(spark):
    row = lambda i, **more: {c: None for c in ("abstract", "publication_date", "venue", "url")} | {"rec_ord": i, "source": "s", "source_id": str(i), "title": "T", "authors": ["A B"], "year": 2020, "doi": None, "arxiv_id": None, "s2_paper_id": None, "citation_count": i, "reference_count": None, "references": [], "seed_queries": [f"q{i % 2}"]} | more
    rows = [row(1, doi="10.1/A"), row(2, doi="https://doi.org/10.1/a", abstract="text", venue="v"), row(3, doi="10.1/b", title="T"), row(4, title="Other"), row(5, title="Other", authors=["Z B"])]
    pool, ambiguous, report = corpus.candidates(spark.createDataFrame(rows, records.SCHEMA + ", rec_ord long"))
    got = {r["canonical_id"]: r for r in pool.collect()}
    assert set(got) == {"doi:10.1/a", "doi:10.1/b", "title:other:2020:b"}
    assert got["doi:10.1/a"]["n_records"] == 2 and got["doi:10.1/a"]["ambiguous"] and got["doi:10.1/a"]["citation_count"] == 2 and got["doi:10.1/a"]["seed_queries"] == ["q0", "q1"]
    assert got["title:other:2020:b"]["n_records"] == 2 and ambiguous.count() == 3
    assert report.first().asDict() == {"raw_records": 5, "candidate_groups": 3, "ambiguous_groups": 1, "duplicates_removed_by_identity": 2}


def test_semantic_scholar_and_gold(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"paperId": "p1", "title": "t", "authors": [{"name": "A B", "authorId": 1}, {"name": None}], "externalIds": {"DOI": "10.1/x"}, "year": 2020}, {"paperId": "p2", "authors": ["C D"]}]}))
    got = {r["source_id"]: r for r in records.read_semantic_scholar(spark, str(tmp_path / "s.json")).collect()}
    assert got["p1"]["authors"] == ["A B"] and got["p2"]["authors"] == ["C D"] and got["p1"]["doi"] == "10.1/x" and got["p2"]["title"] == ""
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"citedPaper": {"paperId": "p3", "title": "u"}}, {"citedPaper": {"paperId": None}}]}))
    assert [r["source_id"] for r in records.read_semantic_scholar_references(spark, str(tmp_path / "r.json")).collect()] == ["p3"]
    pairs = records.citation_contexts(spark.createDataFrame([("a", "b", ["x", "y"]), ("a", "c", [])], "citing string, cited string, contexts array<string>"))
    assert sorted((r["cited"], r["context"] or "") for r in pairs.collect()) == [("b", "x"), ("b", "y"), ("c", "")]
    gold = {"proposals": [{"proposal_id": "dev-001", "split": "dev", "scope": "IN_SCOPE", "raw_text": "t", "facets": [{"facet_id": "dev-001.f1", "facet_text": "x", "gold_label": "UNKNOWN"}], "relevant_papers": [{"paper_id": "paper:a", "relevance": 2}], "gold_tensions": [{"facet_id": "dev-001.f1", "status": "INSUFFICIENT_EVIDENCE"}]}]}
    files.put_text(spark, f"file://{tmp_path}/gold.yaml", json.dumps(gold))
    found = files.read_gold(spark, f"file://{tmp_path}/gold.yaml")
    assert {k: v.count() for k, v in found.items()} == {"proposals": 1, "facets": 1, "tensions": 1, "relevant": 1}
    raw = records.file_digests(spark, str(tmp_path / "s.json"))
    assert records.with_lineage(raw.select(F.col("path").alias("raw_path")), raw).first()["raw_sha256"] == raw.first()["sha256"]


def test_gate_names_the_first_errors(spark):
    found = spark.createDataFrame([("B", "x", "ERROR"), ("A", "y", "ERROR"), ("C", "z", "WARNING")], "code string, location string, severity string")
    with pytest.raises(ValueError, match="^A at y; B at x$"):
        validate.assert_valid(found)
    validate.assert_valid(found.where("severity = 'WARNING'"))
