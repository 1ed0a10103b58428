"""Queries of the integrity checks: real tables with planted violations, and each family's twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import gold as D
from ..operators import ontology as O
from ..operators import reasoning as R
from ..operators import validate as V
from . import views as W
from .registry import query
from .views import KNOWLEDGE, with_


def lit(x) -> str:
    """A Python value as DuckDB text."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        kind = "INTEGER[]" if x and isinstance(x[0], int) else "VARCHAR[]"
        return "[" + ", ".join(map(lit, x)) + f"]::{kind}"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def table(name: str, rows, ddl: str) -> str:
    """A common table expression of fixed rows."""
    cols = [c.strip().split(" ")[0].replace("symmetric", "sym") for c in ddl.split(", ")]  # a reserved word there
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({', '.join(cols)}))"


_SPEC = table("spec", O.RELATIONS, O.RELATION)
_TYPES = table("types", O.ENTITIES, O.ENTITY)
_OK_ID = "regexp_matches({c}, '^[a-z]+:[a-z0-9][a-z0-9_.-]*$')"

# ---------------------------------------------------------------- edges and provenance
_EDGE = "edge_id string, source string, relation string, target string"
_BAD_EDGES = [
    ("bad_01", "paper:o_1", "CITES", "paper:none"), ("bad_02", "method:ring", "PROPOSES", "method:bolt"), ("bad_03", "paper:o_1", "PROPOSES", "technique:red"), ("bad_04", "paper:o_1", "CITED_BY", "paper:o_7"),
    ("bad_05", "paper:o_1", "MEASURES_WITH", "metric:x"), ("bad_06", "paper:o_7", "CITES", "paper:o_7"), ("bad_07", "technique:red", "ALTERNATIVE_TO", "method:ring"), ("bad_08", "technique:red", "GENERALIZES", "technique:blue"),
    ("bad_09", "technique:blue", "SPECIALIZES", "technique:red"), ("bad_10", "paper:o_2", "USES", "method:ring"), ("bad_10", "paper:o_2", "USES", "method:bolt"), ("bad_11", "paper:o_2", "USES", "method:bolt"),
    ("bad_12", "method:ring", "REPORTS_LIMITATION", "limitation:drift"), ("bad_13", "paper:o_3", "NO_SUCH", "paper:o_1"), ("bad_14", "method:x", "ALTERNATIVE_TO", "method:ring"),
]
_PROVENANCE = "edge_id string, source string, relation string, target string, kind string, source_paper string, evidence string, attribution string, ontology_version string, build_version string"
_RING, _OK = ("method:ring", "REPORTS_LIMITATION", "limitation:drift"), ("0.1.0", "0.1.0")
_BAD_PROV = [
    ("bad_20", "paper:o_1", "CITES", "paper:o_7", "RULE_DERIVED", None, None, None, *_OK), ("bad_21", "paper:o_1", "CITES", "paper:o_7", "EXPLICIT_METADATA", None, None, None, "0.0.9", "0.1.0"),
    ("bad_22", "paper:o_1", "CITES", "paper:o_7", "EXPLICIT_METADATA", None, None, "THIRD_PARTY", *_OK), ("bad_23", *_RING, "RULE_DERIVED", None, "x", "THIRD_PARTY", *_OK), ("bad_24", *_RING, "RULE_DERIVED", "paper:none", "x", "THIRD_PARTY", *_OK),
    ("bad_25", *_RING, "MANUALLY_CURATED", "paper:o_3", "", "THIRD_PARTY", *_OK), ("bad_26", *_RING, "MANUALLY_CURATED", "paper:o_3", "x", None, *_OK), ("bad_27", *_RING, "RULE_DERIVED", "paper:o_3", "x", "SELF_REPORTED", *_OK),
    ("bad_28", "method:zz", "REPORTS_LIMITATION", "limitation:drift", "EXPLICIT_METADATA", None, None, None, *_OK), ("bad_29", "paper:o_1", "CITED_BY", "paper:o_7", "EXPLICIT_METADATA", None, None, None, *_OK), ("bad_30", "paper:o_1", "CITES", "paper:o_7", None, None, None, None, None, "0.1.0"),
]
_ENTS = "ents AS (SELECT id, 'paper' AS type FROM ab UNION SELECT entity, type FROM entry WHERE status = 'APPROVED')"
_STATE = _SPEC + ", " + _ENTS + ", " + table("bade", _BAD_EDGES, _EDGE) + ", alle AS (SELECT edge_id, source, relation, target FROM kedge UNION ALL SELECT * FROM bade), full_ AS (SELECT e.*, s.* EXCLUDE (relation), x.type AS st, y.type AS tt FROM alle e LEFT JOIN spec s ON s.relation = e.relation LEFT JOIN ents x ON x.id = e.source LEFT JOIN ents y ON y.id = e.target), known AS (SELECT * FROM full_ WHERE status = 'ACTIVE' AND st IS NOT NULL AND tt IS NOT NULL)"
_E = "'ERROR' AS severity"


def _entities(s, d):
    return W.abstracts(s, d).select("id", F.lit("paper").alias("type")).unionByName(C.approved(W.entries(s, d)).select(F.col("entity").alias("id"), "type"))


@query(
    with_(KNOWLEDGE, ", " + _STATE)
    + f" SELECT 'EDGE_DUP_TRIPLE' AS code, source || '|' || relation || '|' || target AS location, {_E} FROM alle GROUP BY source, relation, target HAVING count(*) > 1 UNION ALL SELECT 'EDGE_DUP_ID', edge_id, 'ERROR' FROM alle GROUP BY edge_id HAVING count(*) > 1"
    " UNION ALL SELECT 'EDGE_RELATION_NOT_STORABLE', edge_id, 'ERROR' FROM full_ WHERE coalesce(status, '') <> 'ACTIVE' UNION ALL SELECT 'EDGE_SELF_LOOP', edge_id, 'ERROR' FROM full_ WHERE status = 'ACTIVE' AND source = target"
    " UNION ALL SELECT 'EDGE_UNKNOWN_ENDPOINT', edge_id, 'ERROR' FROM full_ WHERE status = 'ACTIVE' AND (st IS NULL OR tt IS NULL) UNION ALL SELECT 'EDGE_DOMAIN', edge_id, 'ERROR' FROM known WHERE NOT list_contains(domain, st) UNION ALL SELECT 'EDGE_RANGE', edge_id, 'ERROR' FROM known WHERE NOT list_contains(range, tt)"
    " UNION ALL SELECT 'EDGE_SYMMETRIC_ORDER', edge_id, 'ERROR' FROM known WHERE sym AND source > target UNION ALL SELECT 'EDGE_MIRROR_CONFLICT', edge_id, 'ERROR' FROM known k WHERE EXISTS (SELECT 1 FROM alle m WHERE m.relation = k.mirror_of AND m.source = k.target AND m.target = k.source)"
)
def state_edge_issues(s, d):
    from .knowledge import edges

    own = edges(s, d).select("edge_id", "source", "relation", "target")
    return V.edge_checks(own.unionByName(s.createDataFrame(_BAD_EDGES, _EDGE)), _entities(s, d), O.relations(s))


_PROV = table("badp", _BAD_PROV, _PROVENANCE) + ", allp AS (SELECT e.edge_id, p.source, p.relation, p.target, p.kind, p.source_paper, p.evidence, p.attribution, '0.1.0' AS ontology_version, '0.1.0' AS build_version FROM prov p JOIN kedge e ON e.source = p.source AND e.relation = p.relation AND e.target = p.target UNION ALL SELECT * FROM badp), pk AS (SELECT e.*, s.* EXCLUDE (relation) FROM allp e JOIN spec s ON s.relation = e.relation JOIN ents x ON x.id = e.source JOIN ents y ON y.id = e.target WHERE status = 'ACTIVE'), prop AS (SELECT DISTINCT source, target FROM allp WHERE relation = 'PROPOSES')"


@query(
    with_(KNOWLEDGE, ", " + _STATE + ", " + _PROV)
    + f" SELECT 'EDGE_PROVENANCE_NOT_ALLOWED' AS code, edge_id AS location, {_E} FROM pk WHERE NOT coalesce(list_contains(allowed, kind), false) UNION ALL SELECT 'EDGE_PROV_VERSION', edge_id, 'ERROR' FROM pk WHERE coalesce(ontology_version, '') <> '0.1.0' OR coalesce(build_version, '') <> '0.1.0'"
    " UNION ALL SELECT 'EDGE_ATTRIBUTION_FORBIDDEN', edge_id, 'ERROR' FROM pk WHERE attribution IS NOT NULL AND NOT needs_attribution UNION ALL SELECT 'EDGE_SOURCE_PAPER_REQUIRED', edge_id, 'ERROR' FROM pk WHERE needs_source AND coalesce(source_paper, '') = ''"
    " UNION ALL SELECT 'EDGE_SOURCE_PAPER_INVALID', edge_id, 'ERROR' FROM pk WHERE needs_source AND source_paper <> '' AND source_paper NOT IN (SELECT id FROM ents WHERE type = 'paper') UNION ALL SELECT 'EDGE_EVIDENCE_REQUIRED', edge_id, 'ERROR' FROM pk WHERE needs_evidence AND coalesce(evidence, '') = ''"
    " UNION ALL SELECT 'EDGE_ATTRIBUTION_REQUIRED', edge_id, 'ERROR' FROM pk WHERE needs_attribution AND attribution IS NULL UNION ALL SELECT 'EDGE_ATTRIBUTION_INCONSISTENT', edge_id, 'ERROR' FROM (SELECT pk.*, EXISTS (SELECT 1 FROM prop WHERE prop.source = pk.source_paper AND prop.target = pk.source) AS own FROM pk) WHERE needs_attribution AND source_paper <> '' AND ((attribution = 'SELF_REPORTED' AND NOT own) OR (attribution = 'THIRD_PARTY' AND own))"
)
def state_provenance_issues(s, d):
    from .knowledge import knowledge_rows
    from ..operators import rules as U

    evidence = knowledge_rows(s, d)
    own = evidence.select("source", "relation", "target", "kind", "source_paper", "evidence", "attribution").join(U.edges_of(evidence).select("edge_id", "source", "relation", "target"), ["source", "relation", "target"])
    rows = own.withColumns({"ontology_version": F.lit("0.1.0"), "build_version": F.lit("0.1.0")}).unionByName(s.createDataFrame(_BAD_PROV, _PROVENANCE))
    return V.provenance_checks(rows, _entities(s, d), O.relations(s), "0.1.0", "0.1.0")


# ---------------------------------------------------------------- entities, versions, shapes
_BAD_ENTS = [("paper:x1", "paper", None, None, None), ("Paper:X", "paper", "t", None, None), ("method:a", "concept", None, None, None), ("zzz:a", "method", None, None, None), ("paper:x2", "paper", "t", "MAYBE", "COMPLETE"), ("paper:x3", "paper", "t", None, "HALF"), ("method:dup", "method", None, None, None), ("method:dup", "method", None, None, None), ("concept:", "concept", None, None, None)]


@query(
    with_("pb vocab ab entry", ", " + _TYPES + ", " + table("badx", _BAD_ENTS, "id string, type string, title string, identity_status string, metadata_status string"))
    + ", e AS (SELECT id, 'paper' AS type, title, 'RESOLVED' AS identity_status, 'COMPLETE' AS metadata_status FROM ab UNION ALL SELECT entity, type, NULL, NULL, NULL FROM entry WHERE status = 'APPROVED' UNION ALL SELECT * FROM badx), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM e), ok AS (SELECT *, " + _OK_ID.format(c="id") + f" AS good FROM n WHERE n = 1) SELECT DISTINCT 'ENT_DUP_ID' AS code, id AS location, {_E} FROM n WHERE n > 1 UNION ALL SELECT 'ENT_ID_FORMAT', id, 'ERROR' FROM ok WHERE NOT good"
    " UNION ALL SELECT 'ENT_PREFIX_MISMATCH', id, 'ERROR' FROM ok LEFT JOIN types t ON t.prefix = split_part(id, ':', 1) WHERE good AND t.type IS DISTINCT FROM ok.type UNION ALL SELECT 'ENT_MISSING_ATTR', id || '|title', 'ERROR' FROM ok WHERE good AND type = 'paper' AND coalesce(title, '') = ''"
    " UNION ALL SELECT 'ENT_BAD_STATUS', id || '|identity_status', 'ERROR' FROM ok WHERE good AND type = 'paper' AND identity_status NOT IN ('RESOLVED', 'AMBIGUOUS') UNION ALL SELECT 'ENT_BAD_STATUS', id || '|metadata_status', 'ERROR' FROM ok WHERE good AND type = 'paper' AND metadata_status NOT IN ('COMPLETE', 'PARTIAL_METADATA')"
)
def state_entity_issues(s, d):
    attributes = lambda t, i, m: F.create_map(F.lit("title"), t, F.lit("identity_status"), i, F.lit("metadata_status"), m).alias("attributes")
    none = F.lit(None).cast("string")
    own = W.abstracts(s, d).select("id", F.lit("paper").alias("type"), attributes(F.col("title"), F.lit("RESOLVED"), F.lit("COMPLETE")))
    words = C.approved(W.entries(s, d)).select(F.col("entity").alias("id"), "type", attributes(none, none, none))
    bad = s.createDataFrame(_BAD_ENTS, "id string, type string, title string, i string, m string").select("id", "type", attributes(F.col("title"), F.col("i"), F.col("m")))
    return V.entity_checks(own.unionByName(words).unionByName(bad), O.entities(s))


_STATES = [("good", "0.1.0", "0.1.0", "aa", "aa"), ("old", "0.0.9", "0.1.0", "aa", "aa"), ("other", "0.1.0", "9", "aa", "aa"), ("changed", "0.1.0", "0.1.0", "aa", "bb"), ("empty", None, None, None, "bb")]


@query("WITH " + table("st", _STATES, "state string, o string, s string, c string, a string") + " SELECT 'KS_ONTOLOGY_VERSION' AS code, state AS location, 'ERROR' AS severity FROM st WHERE coalesce(o, '') <> '0.1.0' UNION ALL SELECT 'KS_SCHEMA_VERSION', state, 'ERROR' FROM st WHERE coalesce(s, '') <> '0.1.0' UNION ALL SELECT 'KS_INTEGRITY', state, 'ERROR' FROM st WHERE coalesce(c, '') <> a")
def state_version_issues(s, d):
    return V.version_checks(s.createDataFrame(_STATES, "state string, ontology_version string, schema_version string, content_sha256 string, actual_sha256 string"), "0.1.0", "0.1.0")


@query("WITH " + table("st", [("small", "technique:small"), ("small", "concept:none"), ("small", "concept:lost"), ("fine", "method:ring")], "alias string, c string") + ", " + W.CTE["pb"] + ", " + W.CTE["vocab"] + " SELECT DISTINCT 'AMB_UNKNOWN_CANDIDATE' AS code, alias AS location, 'ERROR' AS severity FROM st WHERE c NOT IN (SELECT entity FROM vocab)")
def state_ambiguity_issues(s, d):
    terms = s.createDataFrame([("small", ["technique:small", "concept:none", "concept:lost"]), ("fine", ["method:ring"])], "alias string, candidates array<string>")
    return V.missing_candidates(terms, W.vocabulary(s, d).select(F.col("entity").alias("id")))


_SHAPE = "row_id string, kind string, source_field string, rule_id string, mapping_decision string, evidence string, curated_by string, curation_ref string"
_SHAPES = [
    ("s01", "EXPLICIT_METADATA", "references", None, None, None, None, None), ("s02", "EXPLICIT_METADATA", "abstract", None, None, None, None, None), ("s03", "EXPLICIT_METADATA", None, "r", None, None, None, None), ("s04", "RULE_DERIVED", "title", "r", "m", "e", None, None),
    ("s05", "RULE_DERIVED", "title", "r", "", "e", None, None), ("s06", "RULE_DERIVED", "references", "r", "m", "e", "me", None), ("s07", "MANUALLY_CURATED", "curation_file", None, None, None, "me", "c1"), ("s08", "MANUALLY_CURATED", "title", "r", None, None, None, "c1"), ("s09", "GUESSED", None, None, None, None, None, None), ("s10", None, "title", None, None, None, None, None),
]


@query(
    with_(KNOWLEDGE, ", " + table("bads", _SHAPES, _SHAPE))
    + ", x AS (SELECT source || '|' || relation || '|' || target || '|' || source_paper AS row_id, kind, source_field, rule_id, CASE WHEN rule_id IS NOT NULL THEN 'm' END AS mapping_decision, evidence, NULL AS curated_by, NULL AS curation_ref FROM prov UNION ALL SELECT * FROM bads), y AS (SELECT row_id, kind, source_field, coalesce(rule_id, '') AS r, coalesce(mapping_decision, '') AS m, coalesce(evidence, '') AS e, coalesce(curated_by, '') AS b, coalesce(curation_ref, '') AS c FROM x)"
    " SELECT 'PROV_METADATA_FIELD' AS code, row_id AS location, 'ERROR' AS severity FROM y WHERE kind = 'EXPLICIT_METADATA' AND coalesce(source_field, '') NOT IN ('authors', 'year', 'venue', 'identifiers', 'references', 'citations') UNION ALL SELECT 'PROV_METADATA_EXTRA', row_id, 'ERROR' FROM y WHERE kind = 'EXPLICIT_METADATA' AND r || b || c <> ''"
    " UNION ALL SELECT 'PROV_RULE_MISSING', row_id, 'ERROR' FROM y WHERE kind = 'RULE_DERIVED' AND (r = '' OR m = '' OR e = '') UNION ALL SELECT 'PROV_RULE_FIELD', row_id, 'ERROR' FROM y WHERE kind = 'RULE_DERIVED' AND coalesce(source_field, '') NOT IN ('title', 'abstract', 'citation_context') UNION ALL SELECT 'PROV_RULE_EXTRA', row_id, 'ERROR' FROM y WHERE kind = 'RULE_DERIVED' AND b || c <> ''"
    " UNION ALL SELECT 'PROV_CURATED_MISSING', row_id, 'ERROR' FROM y WHERE kind = 'MANUALLY_CURATED' AND (b = '' OR c = '') UNION ALL SELECT 'PROV_CURATED_FIELD', row_id, 'ERROR' FROM y WHERE kind = 'MANUALLY_CURATED' AND coalesce(source_field, '') <> 'curation_file' UNION ALL SELECT 'PROV_CURATED_EXTRA', row_id, 'ERROR' FROM y WHERE kind = 'MANUALLY_CURATED' AND r <> '' UNION ALL SELECT 'PROV_KIND', row_id, 'ERROR' FROM y WHERE coalesce(kind, '') NOT IN ('EXPLICIT_METADATA', 'RULE_DERIVED', 'MANUALLY_CURATED')"
)
def provenance_shape_issues(s, d):
    from .knowledge import evidence_rows

    none = F.lit(None).cast("string")
    own = evidence_rows(s, d).select(F.concat_ws("|", "source", "relation", "target", "source_paper").alias("row_id"), "kind", "source_field", "rule_id", "mapping_decision", "evidence", none.alias("curated_by"), none.alias("curation_ref"))
    return V.provenance_shape(own.unionByName(s.createDataFrame(_SHAPES, _SHAPE)))


# ---------------------------------------------------------------- curation
_ENTRY = "entity string, type string, label string, aliases array<string>, status string, approved_by string, approved_on string"
_BAD_ENTRIES = [
    ("paper:x", "paper", "a paper", [], "APPROVED", "me", "2026-01-01"), ("method:c", "concept", "odd", [], "APPROVED", "me", "2026-01-01"), ("method:twice", "method", "twice", [], "DRAFT", None, None), ("method:twice", "method", "twice", ["Shared"], "APPROVED", "me", "2026-01-01"),
    ("technique:s", "technique", "shared", [], "APPROVED", None, None), ("concept:u", "concept", "united", [], "APPROVED", "me", "2026-01-01"), ("problem:u", "problem", "x", ["United"], "APPROVED", "me", "2026-01-01"),
]
_BAD_TERMS = [("united", ["problem:u", "concept:u"]), ("lost", ["method:none", "method:twice"]), ("small", ["technique:small", "concept:small"])]


@query(
    with_("pb vocab entry", ", " + _TYPES + ", " + table("badv", _BAD_ENTRIES, _ENTRY) + ", " + table("bt", [(a, c) for a, cs in _BAD_TERMS for c in cs], "alias string, c string"))
    + ", v AS (SELECT entity, type, label, CASE WHEN more = '' THEN []::VARCHAR[] ELSE [more] END AS aliases, status, CASE WHEN status = 'APPROVED' THEN 'me' END AS approved_by, CASE WHEN status = 'APPROVED' THEN '2026-01-01' END AS approved_on FROM entry UNION ALL SELECT * FROM badv), names AS (SELECT DISTINCT lower(a) AS alias, entity FROM (SELECT entity, unnest(list_concat([label], aliases)) AS a FROM v)), owners AS (SELECT alias, string_agg(entity, ',' ORDER BY entity) AS o, count(*) AS n FROM names GROUP BY 1), said AS (SELECT alias, string_agg(c, ',' ORDER BY c) AS o FROM bt GROUP BY 1)"
    " SELECT 'VOCAB_DUP_ID' AS code, entity AS location, 'ERROR' AS severity FROM v GROUP BY entity HAVING count(*) > 1 UNION ALL SELECT 'VOCAB_WRONG_SOURCE', entity, 'ERROR' FROM v LEFT JOIN types t ON t.type = v.type WHERE coalesce(t.source, '') <> 'APPROVED_VOCABULARY' UNION ALL SELECT 'VOCAB_PREFIX_MISMATCH', entity, 'ERROR' FROM v LEFT JOIN types t ON t.prefix = split_part(entity, ':', 1) WHERE t.type IS DISTINCT FROM v.type"
    " UNION ALL SELECT 'VOCAB_DRAFT', entity, 'WARNING' FROM v WHERE status = 'DRAFT' UNION ALL SELECT 'VOCAB_APPROVAL', entity, 'ERROR' FROM v WHERE status = 'APPROVED' AND (approved_by IS NULL OR approved_on IS NULL) UNION ALL SELECT 'VOCAB_UNDECLARED_AMBIGUITY', o.alias, 'ERROR' FROM owners o LEFT JOIN said s ON s.alias = o.alias WHERE n > 1 AND coalesce(s.o, '') <> o.o UNION ALL SELECT DISTINCT 'VOCAB_AMBIGUITY_CANDIDATE', alias, 'ERROR' FROM bt WHERE c NOT IN (SELECT entity FROM v)"
)
def vocabulary_issues(s, d):
    rows = W.entries(s, d).drop("entry_ord").unionByName(s.createDataFrame(_BAD_ENTRIES, _ENTRY))
    return C.vocabulary_checks(rows, s.createDataFrame(_BAD_TERMS, "alias string, candidates array<string>"), O.entities(s))


_CUR = "curation_id string, source string, relation string, target string, papers array<string>, attribution string, status string"
_CURATED = [
    ("c01", "concept:a", "PREREQUISITE_FOR", "concept:b", [], None, "APPROVED"), ("c02", "paper:a", "PREREQUISITE_FOR", "concept:b", ["paper:a"], None, "APPROVED"), ("c03", "concept:a", "PREREQUISITE_FOR", "limitation:b", [], None, "APPROVED"), ("c04", "paper:a", "CITES", "paper:b", ["paper:a"], None, "APPROVED"),
    ("c05", "paper:a", "CITED_BY", "paper:b", [], "THIRD_PARTY", "DRAFT"), ("c06", "method:b", "ALTERNATIVE_TO", "method:a", [], None, "APPROVED"), ("c07", "concept:a", "GENERALIZES", "concept:b", [], None, "APPROVED"), ("c08", "concept:b", "SPECIALIZES", "concept:a", [], None, "APPROVED"),
    ("c09", "paper:a", "SUPPORTS", "claim:x", ["paper:b"], None, "APPROVED"), ("c10", "method:a", "REPORTS_LIMITATION", "limitation:x", [], None, "APPROVED"), ("c11", "paper:a", "SUPPORTS", "claim:x", ["paper:a"], "THIRD_PARTY", "APPROVED"), ("c12", "concept:a", "COMBINES_WITH", "concept:b", [], None, "DRAFT"),
    ("c13", "odd:a", "GENERALIZES", "concept:b", [], None, "DRAFT"), ("c13", "concept:z", "GENERALIZES", "concept:z", [], None, "APPROVED"), ("c14", "method:a", "REPORTS_LIMITATION", "limitation:x", ["paper:a"], "SELF_REPORTED", "APPROVED"), ("c15", "concept:a", "MEASURES_WITH", "concept:b", None, None, "APPROVED"),
]


@query(
    "WITH " + _SPEC + ", " + _TYPES + ", " + table("c", _CURATED, _CUR)
    + ", f AS (SELECT c.*, s.status AS rs, s.* EXCLUDE (relation, status), x.type AS st, y.type AS tt FROM c LEFT JOIN spec s ON s.relation = c.relation LEFT JOIN types x ON x.prefix = split_part(c.source, ':', 1) LEFT JOIN types y ON y.prefix = split_part(c.target, ':', 1)), a AS (SELECT * FROM f WHERE rs = 'ACTIVE'), k AS (SELECT *, coalesce(papers, []::VARCHAR[]) AS ps FROM a WHERE st IS NOT NULL AND tt IS NOT NULL)"
    " SELECT 'CUR_DUP_ID' AS code, curation_id AS location, 'ERROR' AS severity FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'CUR_RELATION_NOT_STORABLE', curation_id, 'ERROR' FROM f WHERE coalesce(rs, '') <> 'ACTIVE' UNION ALL SELECT 'CUR_NOT_CURATABLE', curation_id, 'ERROR' FROM a WHERE NOT list_contains(allowed, 'MANUALLY_CURATED') UNION ALL SELECT 'CUR_SELF_LOOP', curation_id, 'ERROR' FROM a WHERE source = target"
    " UNION ALL SELECT 'CUR_UNKNOWN_PREFIX', curation_id, 'ERROR' FROM a WHERE st IS NULL OR tt IS NULL UNION ALL SELECT 'CUR_DOMAIN', curation_id, 'ERROR' FROM k WHERE NOT list_contains(domain, st) UNION ALL SELECT 'CUR_RANGE', curation_id, 'ERROR' FROM k WHERE NOT list_contains(range, tt) UNION ALL SELECT 'CUR_SYMMETRIC_ORDER', curation_id, 'ERROR' FROM k WHERE sym AND source > target"
    " UNION ALL SELECT 'CUR_MIRROR_CONFLICT', curation_id, 'ERROR' FROM k WHERE EXISTS (SELECT 1 FROM c m WHERE m.relation = k.mirror_of AND m.source = k.target AND m.target = k.source) UNION ALL SELECT 'CUR_SOURCE_PAPER_REQUIRED', curation_id, 'ERROR' FROM k WHERE needs_source AND len(ps) = 0 UNION ALL SELECT 'CUR_ATTRIBUTION_REQUIRED', curation_id, 'ERROR' FROM k WHERE needs_attribution AND attribution IS NULL"
    " UNION ALL SELECT 'CUR_ATTRIBUTION_FORBIDDEN', curation_id, 'ERROR' FROM k WHERE attribution IS NOT NULL AND NOT needs_attribution UNION ALL SELECT 'CUR_EVIDENCE_REQUIRED', curation_id, 'ERROR' FROM k WHERE st = 'paper' AND NOT list_contains(ps, source) UNION ALL SELECT 'CUR_DRAFT', curation_id, 'WARNING' FROM k WHERE status = 'DRAFT'"
)
def curation_issues(s, d):
    return C.curation_checks(s.createDataFrame(_CURATED, _CUR), O.relations(s), O.entities(s))


# ---------------------------------------------------------------- gold sets
_PROP = "proposal_id string, split string, scope string, raw_text string, n_relevant int"
_PROPS = [("test-001", "test", "IN_SCOPE", "t", 2), ("test-002", "test", "IN_SCOPE", "t", 0), ("test-003", "test", "OUT_OF_SCOPE", "t", 1), ("test-004", "test", "OUT_OF_SCOPE", "t", 0), ("dev-001", "dev", "IN_SCOPE", "t", 0), ("test-004", "test", "OUT_OF_SCOPE", "t", 0)]
_FACET = "proposal_id string, facet_id string, facet_text string, gold_label string, is_combination boolean, concepts array<string>"
_LONG = "how agents keep what they have seen before"
_FACETS = [
    ("test-001", "test-001.f1", _LONG, "UNKNOWN", True, ["concept:a"]), ("test-001", "test-001.f2", "too short", "UNKNOWN", False, ["method:a", "concept:b"]), ("test-001", "test-001.f3", "a Concept:episodic thing within longer text here", "UNKNOWN", False, []), ("test-002", "test-002.f1", "episodic_memory is a name in this longer text", "UNKNOWN", False, []),
    ("test-002", "test-002.f2", "this is an Underexplored and novel part of it", "UNKNOWN", False, []), ("test-003", "test-003.f1", _LONG, "WELL_EXPLORED", False, []), ("test-003", "test-003.f2", _LONG, "UNKNOWN", False, []), ("test-003", "test-001.f9", _LONG, "UNKNOWN", False, []), ("test-003", "odd", _LONG, "UNKNOWN", False, []), ("test-001", "test-001.f1", _LONG, "UNKNOWN", False, []),
]
_TENSION = "proposal_id string, facet_id string, status string, supporting array<string>, challenging array<string>"
_TENSIONS = [("test-001", "test-001.f1", "CONFLICTING", ["p1"], ["p2"]), ("test-001", "test-001.f2", "CONFLICTING", ["p1"], ["p1"]), ("test-001", "test-001.f3", "CONFLICTING", [], ["p1", "p2"]), ("test-002", "test-001.f1", "INSUFFICIENT_EVIDENCE", [], [])]
_HINTED = ", ".join(f"'{h}'" for h in D.HINTS)
_TEXTS = (
    "SELECT 'GOLD_FACET_SHORT' AS code, facet_id AS location, 'ERROR' AS severity FROM f WHERE len(list_filter(string_split_regex(trim(facet_text), '\\s+'), lambda w: w <> '')) < 6 UNION ALL SELECT 'GOLD_ONTOLOGY_LEAK', facet_id, 'ERROR' FROM f WHERE regexp_matches(facet_text, '(?i)\\b(benchmark|claim|concept|direction|limitation|method|paper|problem|technique):[a-z0-9][a-z0-9_.-]*') OR regexp_matches(facet_text, '\\b[a-z]+(_[a-z]+)+\\b')"
    f" UNION ALL SELECT 'GOLD_LABEL_HINT', facet_id || '|' || h, 'WARNING' FROM f, (SELECT unnest([{_HINTED}]) AS h) WHERE contains(lower(facet_text), h)"
)


@query(
    "WITH " + table("p", _PROPS, _PROP) + ", " + table("own", _FACETS, _FACET) + ", " + table("t", _TENSIONS, _TENSION)
    + ", f AS (SELECT * FROM own UNION ALL SELECT 'bench', 'b' || item_id, text, 'UNKNOWN', true, []::VARCHAR[] FROM benchmark), g AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(combined, false) AS combined, coalesce(labelled, 0) AS labelled FROM p LEFT JOIN (SELECT proposal_id, count(*) AS n, bool_or(is_combination) AS combined, count(*) FILTER (WHERE gold_label <> 'UNKNOWN') AS labelled FROM f GROUP BY 1) x USING (proposal_id)) "
    + _TEXTS
    + " UNION ALL SELECT 'GOLD_FACET_COUNT', proposal_id, 'ERROR' FROM g WHERE n < 3 OR n > 5 UNION ALL SELECT 'GOLD_NO_COMBINATION', proposal_id, 'ERROR' FROM g WHERE scope = 'IN_SCOPE' AND NOT combined UNION ALL SELECT 'GOLD_OOS_LABEL', proposal_id, 'ERROR' FROM g WHERE scope = 'OUT_OF_SCOPE' AND labelled > 0 UNION ALL SELECT 'GOLD_OOS_RELEVANT', proposal_id, 'ERROR' FROM g WHERE scope = 'OUT_OF_SCOPE' AND n_relevant > 0"
    " UNION ALL SELECT 'GOLD_CONCEPT_ID', facet_id || '|' || c, 'ERROR' FROM (SELECT facet_id, unnest(concepts) AS c FROM f) WHERE NOT starts_with(c, 'concept:') UNION ALL SELECT 'GOLD_TENSION_FACET', t.proposal_id || '|' || t.facet_id, 'ERROR' FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.proposal_id = t.proposal_id AND f.facet_id = t.facet_id)"
    " UNION ALL SELECT 'GOLD_TENSION_CONFLICTING', proposal_id || '|' || facet_id, 'ERROR' FROM t WHERE status = 'CONFLICTING' AND (len(supporting) = 0 OR len(challenging) = 0 OR len(list_distinct(list_concat(supporting, challenging))) < 2)"
)
def gold_issues(s, d):
    bench = W.table(s, d, "benchmark").select(F.lit("bench").alias("proposal_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("facet_id"), F.col("text").alias("facet_text"), F.lit("UNKNOWN").alias("gold_label"), F.lit(True).alias("is_combination"), F.array().cast("array<string>").alias("concepts"))
    return D.gold_checks(s.createDataFrame(_PROPS, _PROP), s.createDataFrame(_FACETS, _FACET).unionByName(bench), s.createDataFrame(_TENSIONS, _TENSION))


@query(
    "WITH " + table("p", _PROPS, _PROP) + ", " + table("f", _FACETS, _FACET)
    + " SELECT 'GOLD_DUP_PROPOSAL' AS code, proposal_id AS location, 'ERROR' AS severity FROM p GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'GOLD_DUP_FACET', facet_id, 'ERROR' FROM f GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'GOLD_SPLIT', proposal_id, 'ERROR' FROM p WHERE split <> 'test' OR NOT regexp_matches(proposal_id, '^test-[0-9]{3}$')"
    " UNION ALL SELECT 'GOLD_FACET_ID', facet_id, 'ERROR' FROM f WHERE NOT regexp_matches(facet_id, '^(dev|test)-[0-9]{3}\\.f[1-9][0-9]*$') UNION ALL SELECT 'GOLD_FACET_STRAY', facet_id, 'ERROR' FROM f WHERE NOT starts_with(facet_id, proposal_id || '.')"
)
def gold_schema_issues(s, d):
    return D.gold_schema_checks(s.createDataFrame(_PROPS, _PROP), s.createDataFrame(_FACETS, _FACET), "test")


# ---------------------------------------------------------------- ontology
_ODD_TYPES = [*(e for e in O.ENTITIES if e[0] not in ("claim", "paper")), ("paper", "paper", "CORPUS", []), ("metric", "method", "CORPUS", [])]
_ODD = [
    *(r for r in O.RELATIONS if r[0] not in ("MOTIVATES", "GENERALIZES")),
    *(O.relation_row(*r) for r in (
        ("GENERALIZES", ["concept"], ["concept"], "ACTIVE", ["MANUALLY_CURATED"], {"edges": [5, 15], "curated": [1, 15]}),
        ("HAS_LIMITATION", ["metric"], ["author"], "ACTIVE", [], {"primary_source": "RULE_DERIVED", "inverse_of": "CITES", "curated": [0, 1]}),
        ("ODD_A", ["paper"], ["concept"], "DEFERRED", ["RULE_DERIVED"], {"needs_source": True, "inverse_of": "CITES"}),
        ("ODD_B", ["paper"], ["method"], "DERIVED_INVERSE", [], {"inverse_of": "USES"}),
        ("ODD_C", ["paper"], ["method"], "DERIVED_INVERSE", [], {"inverse_of": "NOWHERE"}),
        ("ODD_D", ["paper"], ["paper"], "DERIVED_INVERSE", [], {"inverse_of": "CITED_BY"}),
        ("ODD_E", ["paper"], ["method"], "ACTIVE", ["RULE_DERIVED"], {"symmetric": True, "needs_attribution": True, "range_extension": True, "range_semantics": ["concept"], "mirror_of": "MEASURES_WITH"}),
        ("ODD_F", ["paper"], ["method"], "ACTIVE", ["RULE_DERIVED"], {"range_semantics": ["method"], "primary_source": "MANUALLY_CURATED"}),
    )),
]
_NE = "(len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0 OR len(list_filter({b}, lambda x: NOT list_contains({a}, x))) > 0)"


def _ont(cond: str, code: str) -> str:
    return f"SELECT '{code}' AS code, relation AS location FROM s WHERE {cond}"


@query(
    "WITH " + table("types", _ODD_TYPES, O.ENTITY) + ", " + table("s", _ODD, O.RELATION) + ", " + table("ct", [(e[0],) for e in O.ENTITIES], "type string") + ", " + table("cr", [(r[0],) for r in O.RELATIONS], "relation string")
    + ", m AS (SELECT relation, status, unnest(list_concat(domain, range)) AS t FROM s), i AS (SELECT s.*, o.relation AS o, o.status AS os, o.domain AS od, o.range AS orr FROM s LEFT JOIN s o ON o.relation = s.inverse_of WHERE s.status = 'DERIVED_INVERSE'), w AS (SELECT s.*, o.status AS os, o.domain AS od, o.range AS orr FROM s LEFT JOIN s o ON o.relation = s.mirror_of WHERE s.mirror_of IS NOT NULL) "
    + " UNION ALL ".join([
        "SELECT DISTINCT 'ONT_UNKNOWN_TYPE' AS code, relation AS location FROM m WHERE t NOT IN (SELECT type FROM types) AND NOT (status = 'DEFERRED' AND t = 'metric')", _ont("status = 'DEFERRED' AND NOT list_contains(list_concat(domain, range), 'metric')", "ONT_DEFERRED_TYPE"),
        _ont("status = 'ACTIVE' AND len(allowed) = 0", "ONT_ACTIVE_PROVENANCE"), _ont("status = 'ACTIVE' AND NOT list_contains(allowed, primary_source)", "ONT_PRIMARY_SOURCE"), _ont("status = 'ACTIVE' AND inverse_of IS NOT NULL", "ONT_ACTIVE_INVERSE"), _ont("status <> 'ACTIVE' AND primary_source <> 'NONE'", "ONT_UNSTORED_SOURCE"),
        _ont("status <> 'ACTIVE' AND len(allowed) > 0", "ONT_UNSTORED_PROVENANCE"), _ont("status = 'DEFERRED' AND inverse_of IS NOT NULL", "ONT_INVERSE_ONLY"), _ont("sym AND " + _NE.format(a="domain", b="range"), "ONT_SYMMETRIC_TYPES"), _ont("status <> 'ACTIVE' AND (needs_source OR needs_evidence OR needs_attribution)", "ONT_FLAGS_ACTIVE"),
        _ont("needs_attribution AND NOT (needs_source AND needs_evidence)", "ONT_FLAGS_ATTRIBUTION"), _ont("range_extension AND len(range) < 2", "ONT_RANGE_SINGLE"), _ont("range_extension AND " + _NE.format(a="range", b="range_semantics"), "ONT_RANGE_SEMANTICS"), _ont("NOT range_extension AND len(range_semantics) > 0", "ONT_RANGE_SEMANTICS_ONLY"),
        _ont("allowed = ['MANUALLY_CURATED'] AND curated <> edges", "ONT_ESTIMATE_CURATED"), _ont("NOT list_contains(allowed, 'MANUALLY_CURATED') AND curated <> [0, 0]", "ONT_ESTIMATE_UNCURATED"), _ont("relation IN ('CONFLICTING', 'INSUFFICIENT_EVIDENCE', 'HAS_LIMITATION')", "ONT_NON_RELATION"),
        "SELECT 'ONT_TYPE_EXTRA', type FROM types WHERE type NOT IN (SELECT type FROM ct)", "SELECT 'ONT_TYPE_MISSING', type FROM ct WHERE type NOT IN (SELECT type FROM types)", "SELECT 'ONT_RELATION_EXTRA', relation FROM s WHERE relation NOT IN (SELECT relation FROM cr)", "SELECT 'ONT_RELATION_MISSING', relation FROM cr WHERE relation NOT IN (SELECT relation FROM s)",
        "SELECT 'ONT_PREFIX_REPEATED', prefix FROM types GROUP BY prefix HAVING count(*) > 1", "SELECT 'ONT_PAPER_TITLE', type FROM types WHERE type = 'paper' AND NOT list_contains(required, 'title')", "SELECT 'ONT_TYPE_SET_ASIDE', type FROM types WHERE type IN ('metric', 'author', 'dataset')",
        "SELECT 'ONT_INVERSE_MISSING', relation FROM i WHERE o IS NULL", "SELECT 'ONT_INVERSE_INACTIVE', relation FROM i WHERE os <> 'ACTIVE'", "SELECT 'ONT_INVERSE_TYPES', relation FROM i WHERE o IS NOT NULL AND (" + _NE.format(a="domain", b="orr") + " OR " + _NE.format(a="range", b="od") + ")",
        "SELECT 'ONT_MIRROR_INACTIVE', relation FROM w WHERE coalesce(os, '') <> 'ACTIVE'", "SELECT 'ONT_MIRROR_TYPES', relation FROM w WHERE os = 'ACTIVE' AND (" + _NE.format(a="domain", b="od") + " OR " + _NE.format(a="range", b="orr") + ")",
    ])
)
def ontology_issues(s, d):
    return O.self_checks(O.entities(s, tuple(_ODD_TYPES)), O.relations(s, tuple(_ODD)))


@query("WITH " + _SPEC + " SELECT count(*) AS relations, count(*) FILTER (WHERE status = 'ACTIVE') AS stored, sum(edges[1])::BIGINT AS edges_least, sum(edges[2])::BIGINT AS edges_most, sum(curated[1])::BIGINT AS curated_least, sum(curated[2])::BIGINT AS curated_most FROM spec")
def inventory_totals(s, d):
    return O.inventory_totals(O.relations(s))


# ---------------------------------------------------------------- configuration and output
_WEIGHTS = [("concept", 0.30), ("method", 0.20), ("problem", 0.15), ("benchmark", 0.10), ("proximity", 0.10), ("citation", -0.10), ("temporal", 0.05)]


@query("WITH " + table("w", _WEIGHTS, "name string, value double") + " SELECT 'CFG_WEIGHT_NEGATIVE' AS code, name AS location, 'ERROR' AS severity FROM w WHERE value < 0 UNION ALL SELECT 'CFG_WEIGHT_SUM', 'weights', 'ERROR' FROM (SELECT sum(value) AS s FROM w) WHERE abs(s - 1) > 1e-9 UNION ALL SELECT 'CFG_RANGE', name, 'ERROR' FROM (VALUES ('early', 8, 10), ('late', 5, 3)) AS v(name, lo, hi) WHERE lo > hi UNION ALL SELECT 'CFG_UNKNOWN_KEY', name, 'ERROR' FROM (VALUES ('gold'), ('typo')) AS v(name) WHERE name NOT IN ('gold', 'traversal')")
def config_issues(s, d):
    names = lambda *xs: s.createDataFrame([(x,) for x in xs], "name string")
    return V.config_checks(s.createDataFrame(_WEIGHTS, "name string, value double"), s.createDataFrame([("early", 8, 10), ("late", 5, 3)], "name string, lo int, hi int"), names("gold", "typo"), names("gold", "traversal"))


_POSITIONS = [(1, "HIGH"), (2, "INSUFFICIENT"), (3, "INSUFFICIENT"), (4, "LOW"), (4, "LOW")]
_PATH = [(1, 1, "a", "shares 1 grounded vocabulary entries with proposal"), (1, 2, "b", "this research appears novel"), (2, 2, "a", "x"), (3, 1, "a", "x"), (3, 2, "a", "x")]
_WARNED = [(1, ""), (2, R.INSUFFICIENT), (3, "nothing"), (4, "Your idea is truly novel"), (5, "")]
_CONFLICTS = [("c1", 1, 1, 2, "CONFLICTING"), ("c2", 1, 0, 2, "CONFLICTING"), ("c3", 1, 1, 1, "CONFLICTING"), ("c4", 0, 0, 0, "INSUFFICIENT_EVIDENCE")]
_NOVEL = "regexp_matches({c}, '(?i)\\b(this|your|the)\\s+(proposal|research|idea|work)\\s+(is|appears|seems)\\s+(\\w+\\s+)?novel\\b|\\bno prior work (exists|has been)\\b')"


@query(
    "WITH " + table("pos", _POSITIONS, "request_id long, sufficiency string") + ", " + table("path", _PATH, "request_id long, rank int, paper string, reason string") + ", " + table("w", _WARNED, "request_id long, warnings string") + ", " + table("t", _CONFLICTS, "claim string, a long, b long, n long, status string")
    + " SELECT 'OUT_POSITION_REPEATED' AS code, request_id::VARCHAR AS location FROM pos GROUP BY request_id HAVING count(*) > 1 UNION ALL SELECT 'OUT_POSITION_MISSING', request_id::VARCHAR FROM w WHERE request_id NOT IN (SELECT request_id FROM pos) UNION ALL SELECT 'OUT_RANKS', request_id::VARCHAR FROM path GROUP BY request_id HAVING max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) UNION ALL SELECT 'OUT_PAPER_REPEATED', request_id::VARCHAR FROM path GROUP BY request_id HAVING count(DISTINCT paper) <> count(*)"
    f" UNION ALL SELECT 'OUT_MESSAGE_MISSING', p.request_id::VARCHAR FROM pos p LEFT JOIN w USING (request_id) WHERE sufficiency = 'INSUFFICIENT' AND NOT coalesce(contains(warnings, '{R.INSUFFICIENT}'), false) UNION ALL SELECT 'OUT_NOVELTY', request_id::VARCHAR FROM w WHERE {_NOVEL.format(c='warnings')} UNION ALL SELECT 'OUT_NOVELTY', request_id::VARCHAR FROM path WHERE {_NOVEL.format(c='reason')} UNION ALL SELECT 'OUT_CONFLICT', claim FROM t WHERE status = 'CONFLICTING' AND (a = 0 OR b = 0 OR n < 2)"
)
def output_issues(s, d):
    rows = s.createDataFrame
    return R.output_checks(rows(_POSITIONS, "request_id long, sufficiency string"), rows(_PATH, "request_id long, rank int, paper string, reason string"), rows(_WARNED, "request_id long, warnings string"), rows(_CONFLICTS, "claim string, n_support long, n_challenge long, n_papers long, status string"))
