"""The closed vocabulary of entity types and relations as small tables, and checks that such tables are consistent in themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"
# Type, id prefix, where entities come from, required attributes.
ENTITIES = (
    ("paper", "paper", "CORPUS", ["title"]),
    ("problem", "problem", "APPROVED_VOCABULARY", []),
    ("method", "method", "APPROVED_VOCABULARY", []),
    ("technique", "technique", "APPROVED_VOCABULARY", []),
    ("concept", "concept", "APPROVED_VOCABULARY", []),
    ("benchmark", "benchmark", "APPROVED_VOCABULARY", []),
    ("claim", "claim", "APPROVED_VOCABULARY", []),
    ("limitation", "limitation", "APPROVED_VOCABULARY", []),
    ("direction", "direction", "APPROVED_VOCABULARY", []),
)
DEFERRED, EXCLUDED, NON_RELATIONS = ("metric",), ("author", "dataset"), ("CONFLICTING", "INSUFFICIENT_EVIDENCE", "HAS_LIMITATION")
_CMT = ["concept", "technique", "method"]
# Relation, domain, range, status, allowed provenance, flags.
_RULED, _CURATED = ["RULE_DERIVED", "MANUALLY_CURATED"], ["MANUALLY_CURATED"]
_BASE = (
    ("CITES", ["paper"], ["paper"], "ACTIVE", ["EXPLICIT_METADATA"], {}),
    ("CITED_BY", ["paper"], ["paper"], "DERIVED_INVERSE", [], {"inverse_of": "CITES"}),
    ("ADDRESSES", ["paper"], ["problem", "concept"], "ACTIVE", _RULED, {"range_extension": True, "range_semantics": ["problem", "concept"], "edges": [40, 110], "curated": [0, 15]}),
    ("PROPOSES", ["paper"], ["method"], "ACTIVE", _RULED, {"edges": [20, 45], "curated": [0, 10]}),
    ("USES", ["paper"], ["method", "technique"], "ACTIVE", _RULED, {"edges": [40, 120], "curated": [0, 15]}),
    ("DEPENDS_ON", ["method"], ["technique", "concept"], "ACTIVE", _CURATED, {"edges": [20, 40], "curated": [20, 40]}),
    ("EVALUATES_ON", ["paper"], ["benchmark"], "ACTIVE", _RULED, {"edges": [15, 50], "curated": [0, 8]}),
    ("MEASURES_WITH", ["paper"], ["metric"], "DEFERRED", [], {}),
    ("BUILDS_ON", ["paper"], ["paper"], "ACTIVE", _RULED, {"edges": [0, 25], "curated": [0, 8]}),
    ("EXTENDS", ["paper"], ["paper"], "ACTIVE", _RULED, {"edges": [0, 25], "curated": [0, 8]}),
    ("COMPARES_WITH", ["paper"], ["method"], "ACTIVE", _RULED, {"edges": [5, 30], "curated": [0, 8]}),
    ("SUPPORTS", ["paper"], ["claim"], "ACTIVE", _CURATED, {"edges": [25, 60], "curated": [25, 60]}),
    ("CHALLENGES", ["paper"], ["claim"], "ACTIVE", _CURATED, {"edges": [5, 20], "curated": [5, 20]}),
    ("REPORTS_LIMITATION", ["method"], ["limitation"], "ACTIVE", _RULED, {"primary_source": "MANUALLY_CURATED", "needs_source": True, "needs_evidence": True, "needs_attribution": True, "edges": [10, 30], "curated": [8, 25]}),
    ("MOTIVATES", ["limitation"], ["direction"], "ACTIVE", _CURATED, {"edges": [10, 25], "curated": [10, 25]}),
    ("PREREQUISITE_FOR", _CMT, _CMT, "ACTIVE", _CURATED, {"edges": [20, 40], "curated": [20, 40]}),
    ("ALTERNATIVE_TO", ["method", "technique"], ["method", "technique"], "ACTIVE", _CURATED, {"symmetric": True, "edges": [8, 20], "curated": [8, 20]}),
    ("GENERALIZES", _CMT, _CMT, "ACTIVE", _CURATED, {"edges": [5, 15], "curated": [5, 15]}),
    ("SPECIALIZES", _CMT, _CMT, "ACTIVE", _CURATED, {"mirror_of": "GENERALIZES", "edges": [5, 10], "curated": [5, 10]}),
    ("COMBINES_WITH", _CMT, _CMT, "ACTIVE", _CURATED, {"symmetric": True, "edges": [5, 15], "curated": [5, 15]}),
)
#: The columns of a relation table.
RELATION = (
    "relation string, domain array<string>, range array<string>, status string, allowed array<string>, primary_source string, symmetric boolean, mirror_of string, inverse_of string, "
    "needs_source boolean, needs_evidence boolean, needs_attribution boolean, range_extension boolean, range_semantics array<string>, edges array<int>, curated array<int>"
)
ENTITY = "type string, prefix string, source string, required array<string>"


def relation_row(name: str, domain: list[str], range_: list[str], status: str, allowed: list[str], more: dict) -> tuple:
    """One row of a relation table; flags that are not named are off, and the primary source is the first that is allowed."""
    of = more.get
    return (
        name, domain, range_, status, allowed, of("primary_source", allowed[0] if allowed else "NONE"), of("symmetric", False), of("mirror_of"), of("inverse_of"),
        of("needs_source", False), of("needs_evidence", False), of("needs_attribution", False), of("range_extension", False), of("range_semantics", []), of("edges", [0, 0]), of("curated", [0, 0]),
    )


RELATIONS = tuple(relation_row(*r) for r in _BASE)


def relations(spark: SparkSession, rows: tuple = RELATIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), RELATION)


def entities(spark: SparkSession, rows: tuple = ENTITIES) -> DataFrame:
    return spark.createDataFrame(list(rows), ENTITY)


def _unequal(a: str, b: str) -> str:
    return f"(size(array_except({a}, {b})) > 0 OR size(array_except({b}, {a})) > 0)"


def self_checks(types: DataFrame, spec: DataFrame, deferred: tuple[str, ...] = DEFERRED, excluded: tuple[str, ...] = EXCLUDED, non_relations: tuple[str, ...] = NON_RELATIONS) -> DataFrame:
    """(code, location) of everything that contradicts itself in a type table (ENTITY) and a relation table (RELATION); both small.

    Each check is one filter; keys are compared with the closed vocabulary of this module.
    """
    spark = spec.sparkSession
    text = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    say = lambda df, code, at: df.select(F.lit(code).alias("code"), F.col(at).alias("location"))
    known = types.agg(F.collect_set("type").alias("known"))  # one row of a closed vocabulary
    active, stored = "status = 'ACTIVE'", "status <> 'ACTIVE'"
    rows = spec.crossJoin(F.broadcast(known)).withColumns({"said": F.expr("array_union(domain, range)"), "later": F.expr(text(deferred))})
    other = lambda end: rows.alias("r").join(spec.select(F.col("relation").alias("o"), F.col("status").alias("o_status"), F.col("domain").alias("o_domain"), F.col("range").alias("o_range")), F.col(end) == F.col("o"), "left")
    inverse, mirror = other("inverse_of").where("status = 'DERIVED_INVERSE'"), other("mirror_of").where("mirror_of IS NOT NULL")
    closed = lambda names, col: spark.createDataFrame([(n,) for n in names], f"{col} string")
    type_names, names = closed([e[0] for e in ENTITIES], "type"), closed([r[0] for r in RELATIONS], "relation")
    filters = [
        ("ONT_UNKNOWN_TYPE", f"size(array_except(said, CASE WHEN status = 'DEFERRED' THEN array_union(known, later) ELSE known END)) > 0"), ("ONT_DEFERRED_TYPE", "status = 'DEFERRED' AND NOT arrays_overlap(said, later)"),
        ("ONT_ACTIVE_PROVENANCE", f"{active} AND size(allowed) = 0"), ("ONT_PRIMARY_SOURCE", f"{active} AND NOT array_contains(allowed, primary_source)"), ("ONT_ACTIVE_INVERSE", f"{active} AND inverse_of IS NOT NULL"),
        ("ONT_UNSTORED_SOURCE", f"{stored} AND primary_source <> 'NONE'"), ("ONT_UNSTORED_PROVENANCE", f"{stored} AND size(allowed) > 0"), ("ONT_INVERSE_ONLY", "status = 'DEFERRED' AND inverse_of IS NOT NULL"),
        ("ONT_SYMMETRIC_TYPES", f"symmetric AND {_unequal('domain', 'range')}"), ("ONT_FLAGS_ACTIVE", f"{stored} AND (needs_source OR needs_evidence OR needs_attribution)"),
        ("ONT_FLAGS_ATTRIBUTION", "needs_attribution AND NOT (needs_source AND needs_evidence)"), ("ONT_RANGE_SINGLE", "range_extension AND size(range) < 2"), ("ONT_RANGE_SEMANTICS", f"range_extension AND {_unequal('range', 'range_semantics')}"),
        ("ONT_RANGE_SEMANTICS_ONLY", "NOT range_extension AND size(range_semantics) > 0"), ("ONT_ESTIMATE_CURATED", "allowed = array('MANUALLY_CURATED') AND curated <> edges"),
        ("ONT_ESTIMATE_UNCURATED", "NOT array_contains(allowed, 'MANUALLY_CURATED') AND curated <> array(0, 0)"), ("ONT_NON_RELATION", f"array_contains({text(non_relations)}, relation)"),
    ]
    parts = [say(rows.where(cond), code, "relation") for code, cond in filters] + [
        say(types.join(type_names, "type", "left_anti"), "ONT_TYPE_EXTRA", "type"), say(type_names.join(types, "type", "left_anti"), "ONT_TYPE_MISSING", "type"),
        say(spec.join(names, "relation", "left_anti"), "ONT_RELATION_EXTRA", "relation"), say(names.join(spec, "relation", "left_anti"), "ONT_RELATION_MISSING", "relation"),
        say(types.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "ONT_PREFIX_REPEATED", "prefix"), say(types.where("type = 'paper' AND NOT array_contains(required, 'title')"), "ONT_PAPER_TITLE", "type"),
        say(types.where(F.expr(f"array_contains({text((*deferred, *excluded))}, type)")), "ONT_TYPE_SET_ASIDE", "type"),
        say(inverse.where("o IS NULL"), "ONT_INVERSE_MISSING", "relation"), say(inverse.where("o_status <> 'ACTIVE'"), "ONT_INVERSE_INACTIVE", "relation"),
        say(inverse.where(f"o IS NOT NULL AND ({_unequal('domain', 'o_range')} OR {_unequal('range', 'o_domain')})"), "ONT_INVERSE_TYPES", "relation"),
        say(mirror.where("coalesce(o_status, '') <> 'ACTIVE'"), "ONT_MIRROR_INACTIVE", "relation"), say(mirror.where(f"o_status = 'ACTIVE' AND ({_unequal('domain', 'o_domain')} OR {_unequal('range', 'o_range')})"), "ONT_MIRROR_TYPES", "relation"),
    ]
    return reduce(DataFrame.unionByName, parts)


def inventory_totals(spec: DataFrame) -> DataFrame:
    """One row: relations, how many are stored, and the sums of the least and most edges and curated edges that are expected."""
    total = lambda c, i: F.sum(F.get(c, F.lit(i))).alias(f"{c}_{('least', 'most')[i]}")
    return spec.agg(F.count("*").alias("relations"), F.count_if(F.col("status") == "ACTIVE").alias("stored"), total("edges", 0), total("edges", 1), total("curated", 0), total("curated", 1))
