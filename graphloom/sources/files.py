"""Small files and states: YAML or JSON documents, record caches listed by a manifest, pools, and knowledge states that are read fail-fast."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import SCHEMA


class StateCorrupt(ValueError):
    """A stored state is missing, unreadable, or not of its schema."""


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's whole text, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, replacing it, to any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_document(spark: SparkSession, path: str) -> Any:
    """A small YAML or JSON file as Python values; without a YAML library only JSON is read."""
    text = get_text(spark, path)
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


VOCABULARY = "entity string, type string, label string, aliases array<string>, definition string, status string, approved_by string, approved_on string, entry_ord int"


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, ambiguous terms) of a curation file with ``entries`` and ``ambiguous_terms``."""
    found = read_document(spark, path) or {}
    rows = []
    for k, e in enumerate(found.get("entries") or []):
        approval = e.get("approval") or {}
        rows.append((e["id"], e["id"].split(":", 1)[0], e["label"], list(e.get("aliases") or []), e.get("definition"), approval.get("status", "DRAFT"), approval.get("approved_by"), str(approval["approved_on"]) if approval.get("approved_on") else None, k))
    terms = [(t["input"], list(t["candidates"])) for t in found.get("ambiguous_terms") or []]
    return spark.createDataFrame(rows, VOCABULARY), spark.createDataFrame(terms, "alias string, candidates array<string>")


CURATED = "ord int, curation_id string, source string, relation string, target string, papers array<string>, paper string, passage string, attribution string, status string"


def read_curated_edges(spark: SparkSession, path: str) -> DataFrame:
    """Curated edges of a curation file with ``edges``; the first passage stands for the edge's evidence."""
    rows = []
    for k, e in enumerate((read_document(spark, path) or {}).get("edges") or []):
        passages = e.get("evidence") or []
        first = passages[0] if passages else {}
        rows.append((k, e["curation_id"], e["source"], e["relation"], e["target"], [p.get("paper_id") for p in passages], first.get("paper_id"), first.get("passage"), e.get("attribution"), (e.get("approval") or {}).get("status", "DRAFT")))
    return spark.createDataFrame(rows, CURATED)


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """proposals, facets, tensions and relevant papers of a gold file with ``proposals``."""
    proposals, facets, tensions, relevant = [], [], [], []
    for p in (read_document(spark, path) or {}).get("proposals") or []:
        pid = p["proposal_id"]
        proposals.append((pid, p["split"], p["scope"], p["raw_text"], len(p.get("relevant_papers") or [])))
        facets += [(pid, f["facet_id"], f["facet_text"], f["gold_label"], bool(f.get("is_combination")), list(f.get("gold_concepts") or [])) for f in p["facets"]]
        tensions += [(pid, t["facet_id"], t.get("claim_id"), t["status"], list(t.get("supporting") or []), list(t.get("challenging") or [])) for t in p.get("gold_tensions") or []]
        relevant += [(pid, r["paper_id"], int(r["relevance"])) for r in p.get("relevant_papers") or []]
    return {
        "proposals": spark.createDataFrame(proposals, "proposal_id string, split string, scope string, raw_text string, n_relevant int"),
        "facets": spark.createDataFrame(facets, "proposal_id string, facet_id string, facet_text string, gold_label string, is_combination boolean, concepts array<string>"),
        "tensions": spark.createDataFrame(tensions, "proposal_id string, facet_id string, claim string, status string, supporting array<string>, challenging array<string>"),
        "relevant": spark.createDataFrame(relevant, "proposal_id string, paper string, relevance int"),
    }


def read_record_cache(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records of all files that an acquisition manifest (query, provider, status, records_path) lists, with rec_ord and the query among their seed queries.

    Files that several queries list are read for each of them, as each makes a source record of its own. Rows are ordered by query, provider and place in the file.
    """
    listed = manifest.where("status = 'ok' AND records_path IS NOT NULL").select("query", "provider", "records_path").orderBy("query", "provider").collect()  # one row for each query and provider
    parts = []
    for k, m in enumerate(listed):
        rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(m["records_path"])
        parts.append(rows.withColumns({"seed_queries": F.array_union(F.coalesce("seed_queries", F.array().cast("array<string>")), F.array(F.lit(m["query"]))), "rec_ord": F.lit(k << 40) + F.monotonically_increasing_id()}))
    empty = spark.createDataFrame([], SCHEMA + ", rec_ord long")
    return reduce(DataFrame.unionByName, parts, empty)


def read_pool(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A pool of candidates: a folder of Parquet or JSON-lines files, or one JSON array."""
    if exists(spark, f"{path}/_SUCCESS"):
        try:
            return spark.read.schema(schema).parquet(path)
        except PySparkException:
            return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_state_part(spark: SparkSession, path: str, schema: str, needed: tuple[str, ...]) -> DataFrame:
    """One table of a stored state: JSON lines of exactly that schema, with ``needed`` columns never null. Anything else raises StateCorrupt."""
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)
        broken = rows.where(" OR ".join(f"{c} IS NULL" for c in needed)).limit(1).count()  # reads all rows, so that a broken line is found here
        rows.select(F.count(F.struct("*"))).collect()
    except (AnalysisException, PySparkException) as error:
        raise StateCorrupt(f"{path} cannot be read as a state: {type(error).__name__}") from error
    except Exception as error:  # a task's failure comes as a Java error
        raise StateCorrupt(f"{path} cannot be read as a state: {str(error).splitlines()[0]}") from error
    if broken:
        raise StateCorrupt(f"{path} has rows without one of {', '.join(needed)}")
    return rows
