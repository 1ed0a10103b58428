"""The corpus and knowledge builds as plans over DataFrames: records to candidates, candidates to a selection, a selection to a validated state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators import graph as G
from ..operators import identity as I
from ..operators import ontology as O
from ..operators import rules as U
from ..operators import validate as V
from ..session import written

REFERENCE_KEYS = ["source_paper_id", "s2_paper_id", "doi", "arxiv_id", "canonical_id"]
COMPLETE = ["abstract", "year", "venue", "doi", "arxiv_id", "s2_paper_id", "citation_count", "reference_count"]


def candidates(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool, ambiguous, report) of records (SCHEMA and rec_ord).

    Records that share an identifier are one candidate; groups under one fallback key merge unless their identifiers contradict each other.
    Titles and authors come from the most complete record, other values from the first that has them, the id from the first record.
    """
    ids = {"n_doi": T.normalize_doi(F.col("doi")), "n_arxiv": T.normalize_arxiv(F.col("arxiv_id")), "n_s2": T.normalize_s2(F.col("s2_paper_id"))}
    key = T.fallback_key(F.col("title"), F.col("year"), T.first_author_key(F.col("authors")))
    rows = records.withColumns(ids | {"fbk": key, "source_ref": F.concat_ws(":", "source", "source_id")})
    keys = F.array(*[F.concat(F.lit(f"{c}:"), F.col(c)) for c in ids])
    done = written(I.resolve(I.exact_groups(rows, keys), list(ids)), "resolved")
    report = done.agg(F.count("*").alias("raw_records"), F.count_distinct("cand").alias("candidate_groups"), F.count_distinct(F.when(F.col("ambiguous"), F.col("group_fbk"))).alias("ambiguous_groups"))
    report = report.withColumn("duplicates_removed_by_identity", F.col("raw_records") - F.col("candidate_groups"))
    placed = done.withColumn("complete", I.completeness(COMPLETE)).withColumn("rec_ord", F.struct("grp", "rec_ord"))
    # In the group's own order: least record of the exact group, then the record.
    scalars = ["abstract", "year", "publication_date", "venue", "n_doi", "n_arxiv", "n_s2", "url"]
    rolled = I.roll_up(placed, "cand", F.col("complete"), scalars, ["citation_count", "reference_count"], ["source", "source_ref"], ["authors"])
    first = placed.groupBy("cand").agg(F.min_by(I.canonical_id(*[F.col(c) for c in (*ids, "fbk")]), "rec_ord").alias("canonical_id"), F.bool_or("ambiguous").alias("ambiguous"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("seed_queries", F.array().cast("array<string>")))))).alias("seed_queries"))
    refs = I.references_of(placed.select("cand", "rec_ord", "references"), "cand", [*REFERENCE_KEYS, "title"])
    refs = refs.groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("ref_ord", *REFERENCE_KEYS, "title"))).alias("references"))  # one paper's references
    pool = rolled.join(first, "cand").join(refs, "cand", "left").withColumnsRenamed({"n_doi": "doi", "n_arxiv": "arxiv_id", "n_s2": "s2_paper_id", "max_citation_count": "citation_count", "max_reference_count": "reference_count", "all_source": "sources", "all_source_ref": "source_ids"})
    ambiguous = done.where("ambiguous").select("group_fbk", "grp", "rec_ord", "source", "source_id", "title", "doi", "arxiv_id", "s2_paper_id", F.lit("fallback key matched but identifiers differ; not merged").alias("reason"))
    return pool, ambiguous, report


def citations(pool: DataFrame, keys: list[str] = REFERENCE_KEYS) -> DataFrame:
    """(citing, target): each reference's first key, in order of ``keys``, that a candidate goes by; all compared in lower case."""
    names = F.concat(F.array("canonical_id", "doi", "arxiv_id", "s2_paper_id"), F.transform("source_ids", lambda s: F.substring_index(s, ":", -1)))
    dictionary = pool.select(F.col("canonical_id").alias("target"), F.explode(names).alias("key")).where("key <> ''").select(F.lower("key").alias("key"), "target")
    refs = pool.select(F.col("canonical_id").alias("citing"), F.explode("references").alias("r")).select("citing", "r.ref_ord", *[F.lower(F.col(f"r.{k}")).alias(k) for k in keys])
    return I.prioritised_lookup(refs, keys, dictionary)


def select(pool: DataFrame, quotas: DataFrame, target: int, now: int = 2024, early: int = 2021) -> tuple[DataFrame, DataFrame]:
    """(selected candidates in order of their id, with score, parts and reason; citations within the pool)."""
    cites = written(citations(pool), "cites")
    degree = G.degrees(cites.select(F.col("citing").alias("a"), F.col("target").alias("b")))
    rows = pool.join(degree, F.col("canonical_id") == F.col("id"), "left").drop("id").withColumn("n_seeds", F.size("seed_queries"))
    scored = I.score_parts(rows, now).withColumn("bucket", T.year_bucket(F.col("year"), early, now))
    chosen = I.quota_selection(scored.select(F.col("canonical_id").alias("id"), "bucket", "score"), quotas, target)
    reason = F.when(F.size("seed_queries") > 0, F.concat(F.lit("seed:"), F.array_join("seed_queries", ","))).otherwise("reference_expansion")
    out = scored.join(F.broadcast(chosen.select(F.col("id").alias("canonical_id"), "class")), "canonical_id").withColumn("selection_reason", reason)  # as many rows as the target, or the quotas' minima
    return out.orderBy("canonical_id"), cites


def _within(selected: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id of every selected paper, citations a, b between them)."""
    own = selected.select(F.col("canonical_id").alias("id"))
    inner = cites.join(own.select(F.col("id").alias("citing")), "citing", "left_semi").join(own.select(F.col("id").alias("target")), "target", "left_semi")
    return own, inner.select(F.col("citing").alias("a"), F.col("target").alias("b"))


def totals(selected: DataFrame, cites: DataFrame) -> DataFrame:
    """One row: papers, citations between them, papers without any, average degree. Needs no components."""
    own, inner = _within(selected, cites)
    linked = G.both_ways(inner).select(F.col("a").alias("id")).distinct()
    n = selected.agg(F.count("*").alias("papers")).join(F.broadcast(inner.agg(F.count("*").alias("citation_edges")))).join(F.broadcast(own.join(linked, "id", "left_anti").agg(F.count("*").alias("isolated"))))
    return n.withColumn("average_degree", T.round_half_even(2 * F.col("citation_edges") / F.greatest("papers", F.lit(1)), 3))


def statistics(pool: DataFrame, selected: DataFrame, cites: DataFrame) -> dict[str, DataFrame]:
    """Tables of a corpus report: totals, years, missing fields, component sizes, seed coverage."""
    own, inner = _within(selected, cites)
    lost = lambda c: F.count_if(F.size(c) < 1 if c == "authors" else F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c)
    components = own.join(G.components(inner), "id", "left").groupBy(F.coalesce("component_id", "id").alias("c")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))
    seeds = lambda d, name: d.select(F.explode("seed_queries").alias("query")).groupBy("query").agg(F.count("*").alias(name))
    coverage = seeds(pool, "candidates").join(seeds(selected, "selected"), "query", "left").fillna(0, ["selected"])
    return {
        "totals": totals(selected, cites), "years": selected.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("papers")), "missing": selected.agg(*[lost(c) for c in ("abstract", "year", "authors", "venue", "doi", "arxiv_id", "s2_paper_id")]),
        "components": components, "seeds": coverage,
    }


def audit(selected: DataFrame, edges: int, contexts: int) -> DataFrame:
    """One row: how far the selection's texts and ids could carry relations (10 marked abstracts, 20 citation contexts are called enough)."""
    said = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(c)
    rows = selected.agg(F.count("*").alias("papers"), said("abstract"), said("doi"), said("arxiv_id"), said("s2_paper_id"), F.count_if(T.any_marker(F.col("abstract"), T.LIMITATION_MARKERS)).alias("limitation_marked"))
    return rows.select(
        "*", F.lit(edges).alias("citation_edges"), F.lit(contexts).alias("citation_contexts"), F.lit("available_for_validation" if edges else "sparse_or_missing").alias("cites"),
        F.when(F.col("limitation_marked") >= 10, "supported_for_review").otherwise("insufficient").alias("limitations"), F.lit("supported_for_review" if contexts >= 20 else "insufficient").alias("claims"),
    )


def state(selected: DataFrame, vocabulary: DataFrame, terms: DataFrame, curated: DataFrame | None = None, cues: dict[str, str] = T.CUES, build: str = "0.1.0") -> dict[str, DataFrame]:
    """The tables of a knowledge state (entities, edges, provenance, ambiguities) of selected papers and approved vocabulary."""
    spark = selected.sparkSession
    good = C.approved(vocabulary)
    papers = selected.select(F.concat(F.lit("paper:"), T.slug(F.col("canonical_id"))).alias("id"), "canonical_id", "title", "abstract")
    papers = papers.withColumn("paper_ord", F.dense_rank().over(G.Window.orderBy("canonical_id")).cast("long"))  # a selection has a target size
    slugs = papers.select("canonical_id", "id")
    cites = citations(selected, REFERENCE_KEYS).join(slugs.select(F.col("canonical_id").alias("citing"), F.col("id").alias("s")), "citing").join(slugs.select(F.col("canonical_id").alias("target"), F.col("id").alias("t")), "target")
    rows = cites.select(F.col("s").alias("citing"), F.col("t").alias("target"), F.dense_rank().over(G.Window.partitionBy("s").orderBy("t")).alias("ref_ord"), F.col("target").alias("evidence"))
    evidence = written(U.build_evidence(papers, C.alias_rows(good), cues, rows, curated), "evidence")
    edges = written(U.edges_of(evidence), "edges")
    rank = F.row_number().over(G.Window.partitionBy("edge_id").orderBy(*U.ORDER[:5], "source_paper"))
    provenance = evidence.drop("confidence").join(edges.select("edge_id", "source", "relation", "target"), ["source", "relation", "target"]).withColumns({"ord": (rank - 1).cast("long"), "ontology_version": F.lit(O.VERSION), "build_version": F.lit(build)})
    entities = C.paper_entities(selected).unionByName(C.vocabulary_entities(good))
    return {"entities": entities, "edges": edges, "provenance": provenance, "ambiguities": C.kept_ambiguities(terms, vocabulary)}


def check_state(spark: SparkSession, parts: dict[str, DataFrame], versions: DataFrame | None = None, build: str = "0.1.0") -> DataFrame:
    """All violations of a state's tables (code, location, severity)."""
    spec, types = O.relations(spark), O.entities(spark)
    rows = parts["provenance"].drop("source", "relation", "target").join(parts["edges"].select("edge_id", "source", "relation", "target"), "edge_id")
    found = [
        V.entity_checks(parts["entities"], types), V.edge_checks(parts["edges"], parts["entities"], spec), V.provenance_checks(rows, parts["entities"], spec, O.VERSION, build),
        V.missing_candidates(parts["ambiguities"], parts["entities"]),
    ]
    if versions is not None:
        found.append(V.version_checks(versions, O.VERSION, O.VERSION))
    return V.union(*found)
