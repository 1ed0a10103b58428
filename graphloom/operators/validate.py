"""Integrity constraints: every check is a query that returns its violations (code, location, severity).

Entities: id, type, and ``attributes`` (map of strings) where attributes are checked. Edges: source, relation, target, and edge_id where they
are numbered. Provenance rows: the edge's columns with kind, source_paper, evidence, attribution, versions; the primary and all
corroborating ones alike. ``spec`` is a relation table and ``types`` a type table of ``operators.ontology``; both are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

# Fields of bibliographic metadata and of text, statuses of papers.
METADATA_FIELDS = ("authors", "year", "venue", "identifiers", "references", "citations")
TEXT_FIELDS = ("title", "abstract", "citation_context")
IDENTITY_STATUS, METADATA_STATUS = ("RESOLVED", "AMBIGUOUS"), ("COMPLETE", "PARTIAL_METADATA")


def issues(df: DataFrame, code: str, location: Column, severity: str = "ERROR") -> DataFrame:
    return df.select(F.lit(code).alias("code"), location.cast("string").alias("location"), F.lit(severity).alias("severity"))


def flagged(df: DataFrame, checks: list[tuple[str, Column, Column]], severity: str = "ERROR") -> DataFrame:
    """Violations of many checks (code, condition, location) of each row in one pass over df."""
    one = [F.when(cond, F.struct(F.lit(code).alias("code"), at.cast("string").alias("location"))) for code, cond, at in checks]
    return df.select(F.inline(F.array_compact(F.array(*one)))).withColumn("severity", F.lit(severity))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """One violation for each key that occurs more than once."""
    return issues(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), code, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def triple() -> Column:
    return F.concat_ws("|", "source", "relation", "target")


def _at(df: DataFrame) -> Column:
    return F.col("edge_id") if "edge_id" in df.columns else triple()


def version_checks(states: DataFrame, ontology: str, schema: str) -> DataFrame:
    """states: state, ontology_version, schema_version, content_sha256 (as stored), actual_sha256 (as computed)."""
    at = F.col("state")
    return union(
        issues(states.where(~F.col("ontology_version").eqNullSafe(F.lit(ontology))), "KS_ONTOLOGY_VERSION", at), issues(states.where(~F.col("schema_version").eqNullSafe(F.lit(schema))), "KS_SCHEMA_VERSION", at),
        issues(states.where(~F.col("content_sha256").eqNullSafe(F.col("actual_sha256"))), "KS_INTEGRITY", at),
    )


def entity_checks(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Repeated, malformed and misprefixed ids, required attributes that say nothing, unknown statuses of papers. Repeated ids are only reported as such."""
    prefix = T.entity_type(F.col("id"))
    rows = entities.join(F.broadcast(types.select(F.col("prefix").alias("_p"), F.col("type").alias("_of"))), prefix == F.col("_p"), "left").join(F.broadcast(types.select(F.col("type").alias("_t"), "required")), F.col("type") == F.col("_t"), "left")
    wrong = lambda name, allowed: F.col("attributes")[name].isNotNull() & ~F.col("attributes")[name].isin(*allowed)
    said = lambda code, cond, at: F.when(cond, F.array(F.struct(F.lit(code).alias("code"), at.alias("location"))))
    good, paper = prefix.isNotNull(), F.col("type") == "paper"
    lacks = F.filter("required", lambda a: F.coalesce(F.try_element_at("attributes", a), F.lit("")) == "")
    parts = [
        said("ENT_ID_FORMAT", ~good, F.col("id")), said("ENT_PREFIX_MISMATCH", good & ~F.col("_of").eqNullSafe(F.col("type")), F.col("id")),
        F.when(good, F.transform(lacks, lambda a: F.struct(F.lit("ENT_MISSING_ATTR").alias("code"), F.concat_ws("|", "id", a).alias("location")))),
        said("ENT_BAD_STATUS", good & paper & wrong("identity_status", IDENTITY_STATUS), F.concat(F.col("id"), F.lit("|identity_status"))), said("ENT_BAD_STATUS", good & paper & wrong("metadata_status", METADATA_STATUS), F.concat(F.col("id"), F.lit("|metadata_status"))),
    ]
    # Rows are judged where they are; only ids and what is wrong with them meet, to tell repeated ids.
    judged = rows.select("id", F.flatten(F.array_compact(F.array(*parts))).alias("found"))
    once = judged.groupBy("id").agg(F.count("*").alias("n"), F.first("found").alias("found"))
    again = F.array(F.struct(F.lit("ENT_DUP_ID").alias("code"), F.col("id").cast("string").alias("location")))
    return once.select(F.inline(F.when(F.col("n") > 1, again).otherwise(F.col("found")))).withColumn("severity", F.lit("ERROR"))


#: Ends of edges that are sent to every task at most; beyond, they are joined by key.
ENDS = 100_000


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(ENDS + 1).count() <= ENDS else rows


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    """The distinct ends of edges (at, id and the columns asked for), so that an end that many edges share is looked up once."""
    each = F.array(*[F.struct(F.lit(end).alias("at"), F.col(end).alias("id")) for end in ("source", "target")])
    return edges.select(*more, F.inline(each)).distinct()


def unknown_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end that is no entity: each end is looked up once, and edges are held against those that are lost."""
    ends = _ends(edges.select("source", "target")).select("id").distinct()
    lost = written(ends.join(entities.select("id").distinct(), "id", "left_anti"), "lost")
    rows = edges.select("source", "relation", "target")
    for end in ("source", "target"):
        rows = rows.join(_sent(lost.select(F.col("id").alias(end), F.lit(True).alias(f"no_{end}"))), end, "left")
    # A null end is no entity either.
    bad = rows.where("no_source OR no_target OR source IS NULL OR target IS NULL")
    return issues(bad.select("source", "relation", "target").distinct(), "EDGE_UNKNOWN_ENDPOINT", triple())


def typed(edges: DataFrame, entities: DataFrame, spec: DataFrame) -> DataFrame:
    """edges with their relation's spec and what is wrong with their ends: lost_source and lost_target (no entity), odd_source and odd_target (of a type that the relation does not take there).

    Each end of a relation is looked up once, and edges are held against the ends that are lost or odd, which a sound table has few of.
    """
    spec = F.broadcast(spec)
    kind = entities.groupBy("id").agg(F.min("type").alias("type"))
    ends = _ends(edges, "relation").join(spec.where("status = 'ACTIVE'").select("relation", "domain", "range"), "relation").join(kind, "id", "left")
    taken = F.array_contains(F.when(F.col("at") == "source", F.col("domain")).otherwise(F.col("range")), F.col("type"))
    wrong = written(ends.select("relation", "at", "id", F.col("type").isNull().alias("lost"), (~taken).alias("odd")).where("lost OR odd"), "wrong")
    out = edges.join(spec, "relation", "left")
    for end in ("source", "target"):
        own = wrong.where(F.col("at") == end).select("relation", F.col("id").alias(end), F.col("lost").alias(f"lost_{end}"), F.col("odd").alias(f"odd_{end}"))
        out = out.join(_sent(own), ["relation", end], "left")
    said = {f"lost_{end}": F.coalesce(f"lost_{end}", F.col(end).isNull()) for end in ("source", "target")} | {f"odd_{end}": F.coalesce(f"odd_{end}", F.lit(False)) for end in ("source", "target")}
    return out.withColumns(said)


def _edge_flags(at: Column) -> list[tuple[str, Column, Column]]:
    """Checks of ``typed`` edges on relations and types. A relation that is not stored ends an edge's checks, and so does an unknown end."""
    active, known = "coalesce(status = 'ACTIVE', false)", "coalesce(status = 'ACTIVE', false) AND NOT lost_source AND NOT lost_target"
    rules = [("EDGE_RELATION_NOT_STORABLE", f"NOT {active}"), ("EDGE_SELF_LOOP", f"{active} AND source = target"), ("EDGE_DOMAIN", f"{known} AND odd_source"), ("EDGE_RANGE", f"{known} AND odd_target")]
    return [(code, F.expr(cond), at) for code, cond in rules]


def edge_checks(edges: DataFrame, entities: DataFrame, spec: DataFrame) -> DataFrame:
    """All checks of edges as such. A relation that is not stored ends an edge's checks, and so does an unknown end (behind the self-loop)."""
    edges = written(edges, "checked")
    rows, at = typed(edges, entities, spec), _at(edges)
    known = rows.where("status = 'ACTIVE' AND NOT lost_source AND NOT lost_target")
    mirrored = known.where("mirror_of IS NOT NULL").join(edges.select(F.col("source").alias("ms"), F.col("relation").alias("mr"), F.col("target").alias("mt")), F.expr("mirror_of = mr AND source = mt AND target = ms"), "left_semi")
    flags = [*_edge_flags(at), ("EDGE_UNKNOWN_ENDPOINT", F.expr("status = 'ACTIVE' AND (lost_source OR lost_target)"), at), ("EDGE_SYMMETRIC_ORDER", F.expr("status = 'ACTIVE' AND NOT lost_source AND NOT lost_target AND symmetric AND source > target"), at)]
    parts = [flagged(rows, flags), issues(mirrored, "EDGE_MIRROR_CONFLICT", at), duplicates(edges, ["source", "relation", "target"], "EDGE_DUP_TRIPLE")]
    if "edge_id" in edges.columns:
        parts.append(duplicates(edges, ["edge_id"], "EDGE_DUP_ID"))
    return union(*parts)


def domain_range(edges: DataFrame, spec: DataFrame, entities: DataFrame) -> DataFrame:
    """The part of ``edge_checks`` on relations and types; ``spec`` may hold relation, domain, range and status alone."""
    return flagged(typed(edges, entities, spec), _edge_flags(triple()))


def symmetric_mirror(edges: DataFrame, symmetric: list[str], mirrors: dict[str, str]) -> DataFrame:
    """Symmetric relations are stored from the lesser to the greater id; of mirrored relations only one direction may stand."""
    order = issues(edges.where(F.col("relation").isin(*symmetric) & (F.col("source") > F.col("target"))), "EDGE_SYMMETRIC_ORDER", triple())
    names = F.create_map(*[F.lit(x) for pair in mirrors.items() for x in pair])
    other = edges.select(F.col("source").alias("ms"), F.col("relation").alias("mr"), F.col("target").alias("mt"))
    mirrored = edges.withColumn("m", F.try_element_at(names, F.col("relation"))).join(other, (F.col("m") == F.col("mr")) & (F.col("source") == F.col("mt")) & (F.col("target") == F.col("ms")), "left_semi")
    return union(order, issues(mirrored, "EDGE_MIRROR_CONFLICT", triple()))


def attribution(edges: DataFrame) -> DataFrame:
    """A limitation is self-reported exactly where its source paper proposes the method; a missing attribution is a violation of its own.

    edges: source, relation, target, source_paper, attribution.
    """
    proposed = edges.where("relation = 'PROPOSES'").select(F.col("source").alias("pp"), F.col("target").alias("pm")).distinct()
    limits = edges.where("relation = 'REPORTS_LIMITATION'").join(proposed, (F.col("source_paper") == F.col("pp")) & (F.col("source") == F.col("pm")), "left")
    wrong = limits.where(F.col("source_paper").isNotNull() & ((F.col("attribution") == "SELF_REPORTED") != F.col("pp").isNotNull()))
    return union(issues(wrong, "EDGE_ATTRIBUTION_INCONSISTENT", triple()), issues(limits.where("attribution IS NULL"), "EDGE_ATTRIBUTION_REQUIRED", triple()))


def provenance_checks(rows: DataFrame, entities: DataFrame, spec: DataFrame, ontology: str, build: str) -> DataFrame:
    """All checks of provenance rows (source, relation, target, kind, source_paper, evidence, attribution, ontology_version, build_version) of edges that
    pass the checks which end an edge's own."""
    rows = written(rows, "checked")
    at = _at(rows)
    full = typed(rows, entities, spec).where("status = 'ACTIVE' AND NOT lost_source AND NOT lost_target")
    paper = entities.where("type = 'paper'").select(F.col("id").alias("pid")).distinct()
    proposed = rows.where("relation = 'PROPOSES'").select(F.col("source").alias("pp"), F.col("target").alias("pm")).distinct()
    named = full.where("needs_source AND coalesce(source_paper, '') <> ''").join(paper, F.col("source_paper") == F.col("pid"), "left")
    said = full.where("needs_attribution AND attribution IS NOT NULL AND coalesce(source_paper, '') <> ''").join(proposed, F.expr("source_paper = pp AND source = pm"), "left")
    flags = [
        ("EDGE_PROVENANCE_NOT_ALLOWED", F.expr("NOT coalesce(array_contains(allowed, kind), false)")), ("EDGE_PROV_VERSION", ~(F.col("ontology_version").eqNullSafe(F.lit(ontology)) & F.col("build_version").eqNullSafe(F.lit(build)))),
        ("EDGE_ATTRIBUTION_FORBIDDEN", F.expr("attribution IS NOT NULL AND NOT needs_attribution")), ("EDGE_SOURCE_PAPER_REQUIRED", F.expr("needs_source AND coalesce(source_paper, '') = ''")),
        ("EDGE_EVIDENCE_REQUIRED", F.expr("needs_evidence AND coalesce(evidence, '') = ''")), ("EDGE_ATTRIBUTION_REQUIRED", F.expr("needs_attribution AND attribution IS NULL")),
    ]
    return union(
        flagged(full, [(code, cond, at) for code, cond in flags]), issues(named.where("pid IS NULL"), "EDGE_SOURCE_PAPER_INVALID", at),
        issues(said.where("(attribution = 'SELF_REPORTED' AND pp IS NULL) OR (attribution = 'THIRD_PARTY' AND pp IS NOT NULL)"), "EDGE_ATTRIBUTION_INCONSISTENT", at),
    )


def provenance_shape(rows: DataFrame) -> DataFrame:
    """What each kind of provenance must and must not carry. rows: row_id, kind, source_field, rule_id, mapping_decision, evidence, curated_by, curation_ref."""
    no = lambda *cs: " AND ".join(f"coalesce({c}, '') = ''" for c in cs)
    some = lambda *cs: " OR ".join(f"coalesce({c}, '') = ''" for c in cs)
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rules = [
        ("PROV_METADATA_FIELD", f"kind = 'EXPLICIT_METADATA' AND NOT coalesce(source_field IN ({listed(METADATA_FIELDS)}), false)"), ("PROV_METADATA_EXTRA", f"kind = 'EXPLICIT_METADATA' AND NOT ({no('rule_id', 'curated_by', 'curation_ref')})"),
        ("PROV_RULE_MISSING", f"kind = 'RULE_DERIVED' AND ({some('rule_id', 'mapping_decision', 'evidence')})"), ("PROV_RULE_FIELD", f"kind = 'RULE_DERIVED' AND NOT coalesce(source_field IN ({listed(TEXT_FIELDS)}), false)"),
        ("PROV_RULE_EXTRA", f"kind = 'RULE_DERIVED' AND NOT ({no('curated_by', 'curation_ref')})"), ("PROV_CURATED_MISSING", f"kind = 'MANUALLY_CURATED' AND ({some('curated_by', 'curation_ref')})"),
        ("PROV_CURATED_FIELD", "kind = 'MANUALLY_CURATED' AND NOT coalesce(source_field = 'curation_file', false)"), ("PROV_CURATED_EXTRA", "kind = 'MANUALLY_CURATED' AND coalesce(rule_id, '') <> ''"),
        ("PROV_KIND", "NOT coalesce(kind IN ('EXPLICIT_METADATA', 'RULE_DERIVED', 'MANUALLY_CURATED'), false)"),
    ]
    return flagged(rows, [(code, F.expr(cond), F.col("row_id")) for code, cond in rules])


def undeclared_ambiguity(aliases: DataFrame, declared: DataFrame) -> DataFrame:
    """Aliases with several owners whose owners are not exactly the declared candidates. declared: alias, candidates (array)."""
    owners = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.array_sort(F.collect_set("entity")).alias("owners")).where("size(owners) > 1")
    said = declared.select(F.lower("alias").alias("alias"), F.array_sort(F.array_distinct("candidates")).alias("candidates"))
    return issues(owners.join(said, "alias", "left").where("NOT coalesce(owners = candidates, false)"), "VOCAB_UNDECLARED_AMBIGUITY", F.col("alias"))


def missing_candidates(declared: DataFrame, entities: DataFrame, code: str = "AMB_UNKNOWN_CANDIDATE") -> DataFrame:
    """Candidates of declared ambiguous terms (alias, candidates) that are no entity (id): one violation for each term."""
    each = declared.select("alias", F.explode("candidates").alias("c"))
    lost = each.join(entities.select(F.col("id").alias("c")).distinct(), "c", "left_anti")
    return issues(lost.select("alias").distinct(), code, F.col("alias"))


def config_checks(weights: DataFrame, ranges: DataFrame, keys: DataFrame, known: DataFrame) -> DataFrame:
    """Constraints of a configuration: weights (name, value) at least 0 that add up to 1, ranges (name, lo, hi) in order, keys (name) that are known (name)."""
    total = weights.agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-9 OR s IS NULL")
    return union(
        issues(weights.where("value IS NULL OR value < 0"), "CFG_WEIGHT_NEGATIVE", F.col("name")), issues(total, "CFG_WEIGHT_SUM", F.lit("weights")), issues(ranges.where("lo > hi"), "CFG_RANGE", F.col("name")),
        issues(keys.join(known, "name", "left_anti"), "CFG_UNKNOWN_KEY", F.col("name")),
    )


def assert_valid(found: DataFrame, most: int = 20) -> None:
    """Raises with the first errors; warnings pass."""
    errors = found.where("severity = 'ERROR'").orderBy("code", "location").limit(most).collect()
    if errors:
        raise ValueError("; ".join(f"{e['code']} at {e['location']}" for e in errors))
