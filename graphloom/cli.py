"""Command line: ``python -m graphloom.cli COMMAND``.

corpus acquire|normalize|select|all, build, validate, inspect, analyze, schemas, docs, seal. Folders may lie in any store that Spark reads.
Exit codes: 0 done, 1 violations or failures, 2 missing input.
"""

from __future__ import annotations

import argparse
import datetime
import hashlib
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ontology as O
from .operators import reasoning as R
from .operators import validate as V
from .plans import corpus
from .session import session
from .sinks import state as S
from .sources import fetch, files
from .sources.records import SCHEMA
from .sources.sealing import verify_path

VERSIONS = {"schema_version": O.VERSION, "ontology_version": O.VERSION, "corpus_version": O.VERSION, "knowledge_build_version": "0.1.0"}
QUOTAS = [("early", 8, 10), ("middle", 20, 25), ("late", 35, 40)]
MANIFEST = "query string, provider string, status string, error string, record_count long, raw_path string, records_path string"


def utc_now() -> str:
    """The time in UTC, to the second."""
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat()


def lineage(config_text: str) -> dict[str, str | None]:
    """Digest of the configuration and the revision of the working folder, where there is one. Not part of any content digest."""
    try:
        revision = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        revision = None
    return {"config_sha256": hashlib.sha256(config_text.encode()).hexdigest(), "revision": revision, "created_utc": utc_now()}


def _say(df: DataFrame, most: int) -> None:
    for r in df.limit(most).collect():
        print(*[f"{k}={v}" for k, v in r.asDict().items()])


def _config(spark: SparkSession, a: argparse.Namespace) -> dict:
    return (files.read_document(spark, a.config) or {}) if a.config else {}


def acquire(spark: SparkSession, a: argparse.Namespace) -> int:
    key = os.environ.get(a.api_key_env)
    providers = {"both": ["semantic_scholar", "arxiv"], "all": ["semantic_scholar", "arxiv", "openalex"]}.get(a.provider, [a.provider])
    if a.require_key and not key and "semantic_scholar" in providers:
        print(f"{a.api_key_env} is not set", file=sys.stderr)
        return 2
    queries = a.query or _config(spark, a).get("seed_queries") or []
    new = fetch.acquire(spark, queries, providers, a.folder, a.limit, key, a.expand)
    path = f"{a.folder}/acquisition.json"
    old = spark.read.schema(MANIFEST).json(path) if files.exists(spark, path) else new.limit(0)
    merged = S.upsert_manifest(old, new).orderBy("query", "provider").collect()
    files.put_text(spark, path, "".join(r["value"] + "\n" for r in S.canonical(spark.createDataFrame(merged, MANIFEST)).collect()))
    _say(S.acquisition_counts(new), 10)
    return int(any(r["status"] == "error" for r in new.collect()))


def normalize(spark: SparkSession, a: argparse.Namespace) -> int:
    path = f"{a.folder}/acquisition.json"
    if not files.exists(spark, path):
        print("nothing is acquired yet", file=sys.stderr)
        return 2
    pool, ambiguous, report = corpus.candidates(files.read_record_cache(spark, spark.read.schema(MANIFEST).json(path)))
    S.write_pool(pool, ambiguous, f"{a.folder}/pool")
    files.put_text(spark, f"{a.folder}/normalization_report.json", S.dumps(report.first().asDict()))
    _say(report, 1)
    return 0


def select(spark: SparkSession, a: argparse.Namespace) -> int:
    if not files.exists(spark, f"{a.folder}/pool/candidates"):
        print("there is no pool yet", file=sys.stderr)
        return 2
    pool = spark.read.parquet(f"{a.folder}/pool/candidates")
    chosen, cites = corpus.select(pool, spark.createDataFrame(QUOTAS, "bucket string, lo int, hi int"), a.target_size)
    chosen.write.mode("overwrite").parquet(f"{a.folder}/selected")
    chosen = spark.read.parquet(f"{a.folder}/selected")
    stats = corpus.statistics(pool, chosen, cites)
    audit = corpus.audit(chosen, stats["totals"].first()["citation_edges"], 0)
    files.put_text(spark, f"{a.folder}/quality.md", S.render_report("Corpus quality", stats))
    files.put_text(spark, f"{a.folder}/quality.json", S.dumps({k: [r.asDict() for r in v.collect()] for k, v in stats.items()}))
    files.put_text(spark, f"{a.folder}/audit.md", S.render_report("Relation sources", {"audit": audit}))
    S.write_corpus_manifest(chosen.drop("parts", "references"), f"{a.folder}/manifest.json", VERSIONS, {"target_size": a.target_size, "quotas": QUOTAS}, utc_now())
    _say(stats["totals"], 1)
    return 0


def every(spark: SparkSession, a: argparse.Namespace) -> int:
    code = acquire(spark, a)
    return code if code == 2 else normalize(spark, a) or select(spark, a)


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    vocabulary, terms = files.read_vocabulary(spark, a.vocabulary)
    from .operators.curation import vocabulary_checks

    V.assert_valid(vocabulary_checks(vocabulary, terms, O.entities(spark)))
    curated = files.read_curated_edges(spark, a.curated) if a.curated else None
    parts = corpus.state(spark.read.parquet(f"{a.folder}/selected"), vocabulary, terms, curated)
    found = corpus.check_state(spark, parts).where("severity = 'ERROR'")
    _say(found, 20)
    if not found.isEmpty():
        return 1
    manifest = S.save_state(parts, a.out, VERSIONS, lineage(files.get_text(spark, a.vocabulary)))
    files.put_text(spark, f"{a.out}/report.json", S.dumps({k: manifest[k] for k in ("counts", "relation_distribution")}))
    print(manifest["counts"], manifest["content_sha256"])
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    if not files.exists(spark, f"{a.state}/manifest.json"):
        return 2
    parts, manifest = S.load_state(spark, a.state)
    found = corpus.check_state(spark, parts, S.state_versions(parts, manifest))
    _say(found.orderBy("code", "location"), 20)
    return int(not found.where("severity = 'ERROR'").isEmpty())


def inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    from .operators import graph as G

    parts, _ = S.load_state(spark, a.state)
    if a.entity:
        _say(parts["entities"].where(F.col("id") == a.entity), 1)
        _say(G.filter_edges(parts["edges"], node=a.entity).orderBy("edge_id"), 50)
    if a.paper or a.relation:
        _say(G.filter_edges(parts["edges"], relation=a.relation, node=a.paper).orderBy("edge_id"), 50)
    if a.neighbors:
        _say(G.neighbours(parts["edges"], F.lit(a.neighbors)).orderBy("direction", "relation", "neighbour"), 50)
    if a.stats or not (a.entity or a.paper or a.relation or a.neighbors):
        _say(parts["entities"].groupBy("type").agg(F.count("*").alias("n")).orderBy("type"), 50)
        _say(parts["edges"].groupBy("relation").agg(F.count("*").alias("n")).orderBy("relation"), 50)
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    from .operators import curation as C

    text = a.proposal if a.proposal is not None else sys.stdin.read()
    try:
        parts, _ = S.load_state(spark, a.state)
        V.assert_valid(corpus.check_state(spark, parts))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    vocabulary, terms = files.read_vocabulary(spark, a.vocabulary)
    first = parts["provenance"].where("ord = 0").drop("ord", "ontology_version", "build_version")
    edges = parts["edges"].join(first, "edge_id")
    papers = parts["entities"].where("type = 'paper'").select("id", F.expr("try_cast(attributes['year'] AS int)").alias("year"))
    cites = edges.where("relation = 'CITES'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    run = R.Analysis(spark.createDataFrame([(1, text)], "request_id long, text string"), C.alias_rows(vocabulary), edges, papers, cites, a.now, terms.select("alias"))
    if a.json:
        print(run.output().select(F.to_json("output", {"ignoreNullFields": "false"})).first()[0])
        return 0
    for name, df in (("grounding", run.grounded), ("unknown terms", run.unknown), ("prior work", run.ranked.orderBy("rank")), ("reading path", run.reading_path.orderBy("rank")), ("tensions", R.tensions(R.claim_sides(edges))), ("position", run.positions), ("limitations", R.limitations(edges)), ("warnings", run.warnings)):
        print(f"# {name}")
        _say(df, 10)
    if a.verbose:
        print("# evidence")
        _say(run.evidence.orderBy("n"), 10)
    return 0


def schemas(spark: SparkSession, a: argparse.Namespace) -> int:
    stale = S.export_schemas(spark, a.folder, S.SCHEMAS | {"records": SCHEMA, "acquisition": MANIFEST}, a.check)
    print(*stale)
    return int(a.check and bool(stale))


def docs(spark: SparkSession, a: argparse.Namespace) -> int:
    text, path = S.render_ontology(O.entities(spark), O.relations(spark)), f"{a.folder}/ontology.md"
    if a.check:
        return int(not files.exists(spark, path) or files.get_text(spark, path) != text)
    files.put_text(spark, path, text)
    return 0


def seal(spark: SparkSession, a: argparse.Namespace) -> int:
    if not files.exists(spark, a.path):
        return 2
    if a.verify:
        status = verify_path(spark, a.path).first()["status"]
        print(status)
        return int(status != "VALID")
    print(S.seal(spark, a.path))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(of, name: str, run, **options) -> argparse.ArgumentParser:
        p = of.add_parser(name)
        for flag, how in options.items():
            p.add_argument(("--" if how.pop("option", True) else "") + flag.replace("_", "-"), **how)
        p.set_defaults(run=run)
        return p

    steps = sub.add_parser("corpus").add_subparsers(dest="step", required=True)
    folder = lambda: {"required": True}
    search = lambda: dict(query={"action": "append"}, limit={"type": int, "default": 100}, provider={"default": "both", "choices": [*fetch.PROVIDERS, "both", "all"]}, api_key_env={"default": "SEMANTIC_SCHOLAR_API_KEY"}, require_key={"action": "store_true"}, expand={"type": int, "default": 0}, config={})
    target = lambda: {"type": int, "default": 70}
    command(steps, "acquire", acquire, folder=folder(), **search())
    command(steps, "normalize", normalize, folder=folder())
    command(steps, "select", select, folder=folder(), target_size=target())
    command(steps, "all", every, folder=folder(), target_size=target(), **search())
    command(sub, "build", build, folder=folder(), vocabulary=folder(), curated={}, out=folder())
    command(sub, "validate", validate, state={"option": False})
    command(sub, "inspect", inspect, state={"option": False}, stats={"action": "store_true"}, entity={}, paper={}, relation={}, neighbors={})
    command(sub, "analyze", analyze, state=folder(), vocabulary=folder(), proposal={}, json={"action": "store_true"}, verbose={"action": "store_true"}, now={"type": int, "default": 2024})
    command(sub, "schemas", schemas, folder=folder(), check={"action": "store_true"})
    command(sub, "docs", docs, folder=folder(), check={"action": "store_true"})
    command(sub, "seal", seal, path={"option": False}, verify={"action": "store_true"})
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
