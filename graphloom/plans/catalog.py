"""All queries of the library's own operators, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import identity as I
from ..operators import reasoning as R
from ..operators import rules as U
from ..operators import tuning as N
from ..operators import validate as V
from . import views as W
from .registry import ORACLE_SQL, QUERIES, query
from .views import with_

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Words that the invented prose holds, in the place of English cues and markers.
CUES = {"contribution": r"\b(?:ver|ción|pour)\b", "use": r"\b(?:in|de|der)\b", "result": r"\b(?:and|la)\b", "compare": r"\b(?:the|le)\b", "limitation": r"\b(?:to|en)\b"}
STOP = ["erher", "about", "there"]


def docs(s: SparkSession, d: str) -> DataFrame:
    return W.table(s, d, "documents")


@query("SELECT page_id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(trim(lower(url)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:[ \\t]*', '')), '\\.+$', ''), '') AS doi, nullif(trim(regexp_replace(replace(regexp_replace(regexp_replace(trim(lower(url)), '^https?://(www\\.)?arxiv\\.org/(abs|pdf)/', ''), '^arxiv[:/ ]?', ''), '.pdf', ''), 'v[0-9]+$', '')), '') AS arxiv, nullif(CASE WHEN trim(lower(url)) LIKE 'https://%' THEN split_part(trim(lower(url)), '/', -1) ELSE trim(lower(url)) END, '') AS s2, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x') AS slug FROM pages")
def normalize_identifiers(s, d):
    u = F.col("url")
    return W.table(s, d, "pages").select("page_id", T.normalize_doi(u).alias("doi"), T.normalize_arxiv(u).alias("arxiv"), T.normalize_s2(u).alias("s2"), T.slug(u).alias("slug"))


_FOLD = "regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) AS title, 'title:' || trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) || ':' || (CASE WHEN n_chars = 0 THEN 'unknown' ELSE n_chars::VARCHAR END) || ':' || source AS fbk FROM documents")
def normalize_title(s, d):
    first = F.substring_index("text", "\n", 1)
    return docs(s, d).select("doc_id", T.normalize_title(first).alias("title"), T.fallback_key(first, F.col("n_chars"), F.col("source")).alias("fbk"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM documents UNION ALL SELECT -conv_id * 1000 - turn, len(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''))::BIGINT FROM conversations")
def sentence_split(s, d):
    both = docs(s, d).select("doc_id", "text").union(W.table(s, d, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text"))
    return both.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


_MATCH = "regexp_matches(lower({t}), '(^|[^a-z0-9_])' || lower(alias) || '([^a-z0-9_]|$)')"


@query(with_("alias", f"SELECT entity, alias, count(*) AS n FROM documents, alias WHERE {_MATCH.format(t='text')} GROUP BY 1, 2"))
def term_match_counts(s, d):
    return U.term_matches(docs(s, d).select("doc_id", "text"), W.aliases(s)).groupBy("entity", "alias").agg(F.count("*").alias("n"))


@query(with_("alias", f"SELECT doc_id, entity, min(pos)::BIGINT AS pos FROM (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)), alias WHERE {_MATCH.format(t='sentence')} AND regexp_matches(lower(sentence), '\\b(the|le|und)\\b') GROUP BY 1, 2"))
def cue_sentence_matches(s, d):
    rows = U.term_matches(U.sentence_rows(docs(s, d).select("doc_id", "text")).withColumnRenamed("sentence", "text"), W.aliases(s))
    return rows.where(F.rlike(F.lower("text"), F.lit(r"(^|[^a-z0-9_])(the|le|und)($|[^a-z0-9_])"))).groupBy("doc_id", "entity").agg(F.min("pos").alias("pos"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{4,}')), lambda x: x NOT IN ('erher', 'about', 'there')))[1:5], ',') AS terms FROM conversations")
def unknown_terms_top5(s, d):
    return W.table(s, d, "conversations").select("conv_id", "turn", F.array_join(T.terms(F.col("text"), STOP), ",").alias("terms"))


@query("SELECT item_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS text FROM benchmark")
def inverted_index_rebuild(s, d):
    from ..sources.records import abstract_of

    b = W.table(s, d, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "w"))
    index = b.groupBy("item_id", "w").agg(F.collect_list("pos").alias("p")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("m"))
    return index.select("item_id", abstract_of(F.col("m")).alias("text"))


def _records(s, d):
    return I.exact_groups(W.records(s, d), F.array("sha", "lenkey"))


_REACH = "r(a, b) AS (SELECT x.rec_ord, y.rec_ord FROM rec x JOIN rec y ON x.lenkey = y.lenkey OR x.sha = y.sha UNION SELECT r.a, y.rec_ord FROM r JOIN rec x ON r.b = x.rec_ord JOIN rec y ON x.lenkey = y.lenkey OR x.sha = y.sha)"
_GRP = "grp AS (SELECT a AS rec_ord, min(b) AS grp FROM r GROUP BY 1)"
_REC = "WITH RECURSIVE " + W.CTE["rec"] + ", " + _REACH + ", " + _GRP


@query(_REC + " SELECT rec_ord, grp FROM grp")
def identity_components(s, d):
    return _records(s, d).select("rec_ord", "grp")


_FB = ", head AS (SELECT grp, arg_min(fbk, rec_ord) AS fbk FROM rec JOIN grp USING (rec_ord) GROUP BY 1), fb AS (SELECT h.fbk, count(DISTINCT g.grp) AS n_groups, count(*) AS n_records, min(g.grp) AS first_grp, count(DISTINCT g.grp) > 1 AND count(DISTINCT sha) > 1 AS ambiguous FROM rec JOIN grp g USING (rec_ord) JOIN head h ON h.grp = g.grp GROUP BY 1)"


@query(_REC + _FB + " SELECT fbk, n_groups, n_records, first_grp, ambiguous FROM fb")
def identity_ambiguous_groups(s, d):
    return I.fallback_groups(_records(s, d), ["sha"])


@query(_REC + ", x AS (SELECT g.grp AS cand, r.*, (title <> '')::INT + (lang <> '')::INT + (source <> '')::INT AS c FROM rec r JOIN grp g USING (rec_ord)) SELECT cand, count(*) AS n_records, arg_min(title, (-c, source, rec_ord)) AS title, arg_min(lang, rec_ord) AS lang, max(size) AS max_size, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM x GROUP BY 1")
def candidate_rollup(s, d):
    rows = _records(s, d).withColumnRenamed("grp", "cand")
    out = I.roll_up(rows, "cand", I.completeness(["title", "lang", "source"]), ["lang"], ["size"], ["source"])
    return out.select("cand", "n_records", "title", "lang", "max_size", F.array_join("all_source", ",").alias("sources"))


@query(_REC + _FB + ", c AS (SELECT CASE WHEN ambiguous THEN h.grp ELSE first_grp END AS cand FROM head h JOIN fb USING (fbk)) SELECT (SELECT count(*) FROM rec) AS raw, (SELECT count(DISTINCT cand) FROM c) AS groups, (SELECT count(*) FROM fb WHERE ambiguous) AS ambiguous, (SELECT count(*) FROM rec) - (SELECT count(DISTINCT cand) FROM c) AS removed")
def normalization_report(s, d):
    done = I.resolve(_records(s, d), ["sha"])
    amb = done.where("ambiguous").select(F.count_distinct("group_fbk").alias("ambiguous"))
    n = done.agg(F.count("*").alias("raw"), F.count_distinct("cand").alias("groups"))
    return n.join(F.broadcast(amb)).select("raw", "groups", "ambiguous", (F.col("raw") - F.col("groups")).alias("removed"))  # one row each


@query("SELECT a AS citing, b AS target FROM (WITH " + W.CTE["cites"] + " SELECT a, b FROM cites)")
def citation_edges(s, d):
    ids = W.paper(s, d).select(F.col("id").alias("target"))
    dictionary = ids.select(F.upper("target").alias("key"), "target").union(ids.select(F.col("target").alias("key"), "target"))
    refs = W.cites(s, d).select(F.col("a").alias("citing"), F.lit(1).alias("ref_ord"), F.lit(None).cast("string").alias("k1"), F.concat(F.lit("no:"), "b").alias("k2"), F.upper("b").alias("k3"), F.col("b").alias("k4"))
    return I.prioritised_lookup(refs, ["k1", "k2", "k3", "k4"], dictionary)


@query(with_("cites degree", "SELECT id, degree FROM degree"))
def citation_degree(s, d):
    return G.degrees(W.cites(s, d))


@query("SELECT size, count(*) AS n FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1")
def citation_component_sizes(s, d):
    comp = G.components(W.cites(s, d))
    all_ = W.paper(s, d).select("id").join(comp, "id", "left").select(F.coalesce("component_id", "id").alias("c"))
    return all_.groupBy("c").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(with_("paper cites", "SELECT year, count(*) AS papers, count(*) FILTER (WHERE id NOT IN (SELECT a FROM cites UNION SELECT b FROM cites)) AS isolated, sum(citation_count)::BIGINT AS citations FROM paper GROUP BY 1"))
def corpus_stats(s, d):
    linked = G.both_ways(W.cites(s, d)).select(F.col("a").alias("id")).distinct().withColumn("l", F.lit(1))
    return W.paper(s, d).join(linked, "id", "left").groupBy("year").agg(F.count("*").alias("papers"), F.count_if(F.col("l").isNull()).alias("isolated"), F.sum("citation_count").alias("citations"))


@query(with_("paper", "SELECT count(*) AS papers, count(*) FILTER (WHERE citation_count = 0) AS no_citations, count(*) FILTER (WHERE reference_count = 0) AS no_references, count(*) FILTER (WHERE seed IS NULL) AS no_seed FROM paper"))
def missing_metadata(s, d):
    return W.paper(s, d).agg(F.count("*").alias("papers"), F.count_if(F.col("citation_count") == 0).alias("no_citations"), F.count_if(F.col("reference_count") == 0).alias("no_references"), F.count_if(F.col("seed").isNull()).alias("no_seed"))


@query(with_("paper", "SELECT seed, count(*) AS candidates, count(*) FILTER (WHERE year >= 2000) AS recent, CASE WHEN count(*) >= 20 THEN 'strong' WHEN count(*) >= 10 THEN 'fair' ELSE 'weak' END AS cover FROM paper GROUP BY 1"))
def seed_coverage(s, d):
    g = W.paper(s, d).groupBy("seed").agg(F.count("*").alias("candidates"), F.count_if(F.col("year") >= 2000).alias("recent"))
    return g.withColumn("cover", F.when(F.col("candidates") >= 20, "strong").when(F.col("candidates") >= 10, "fair").otherwise("weak"))


@query(with_("ab", "SELECT id, coalesce(" + " OR ".join(f"contains(lower(abstract), '{m}')" for m in T.LIMITATION_MARKERS) + ", false) AS marked FROM ab"))
def limitation_markers(s, d):
    return W.abstracts(s, d).select("id", T.any_marker(F.col("abstract"), T.LIMITATION_MARKERS).alias("marked"))


def _scored(s, d):
    deg = G.degrees(W.cites(s, d))
    p = I.score_parts(W.paper(s, d).withColumn("n_seeds", F.col("seed").isNotNull().cast("int")).join(deg, "id", "left"), W.NOW)
    # Logarithms may differ in their last bits between engines: rounded, so that both order alike.
    return p.withColumn("bucket", T.year_bucket(F.col("year"), 1996, 2000)).withColumn("score", F.round("score", 9))


_SCORED = with_("paper cites degree", "SELECT id, bucket, round(seed_hits + citation_count + reference_count + in_pool_citation_degree + recency, 9) AS score, round(seed_hits, 9) AS seed_hits, round(citation_count, 9) AS citation_count, round(reference_count, 9) AS reference_count, round(in_pool_citation_degree, 9) AS in_pool_citation_degree, round(recency, 9) AS recency FROM (SELECT p.id, CASE WHEN year IS NULL THEN 'unknown' WHEN year <= 1996 THEN 'early' WHEN year < 2000 THEN 'middle' ELSE 'late' END AS bucket, CAST(CASE WHEN seed IS NULL THEN 0 ELSE 10 END AS DOUBLE) AS seed_hits, ln(CAST(1 AS DOUBLE) + citation_count) AS citation_count, CAST(0.5 AS DOUBLE) * ln(CAST(1 AS DOUBLE) + reference_count) AS reference_count, CAST(2 AS DOUBLE) * coalesce(degree, 0) AS in_pool_citation_degree, CAST(CASE WHEN year >= 2001 THEN 1 ELSE 0 END AS DOUBLE) AS recency FROM paper p LEFT JOIN degree d ON p.id = d.id)")


@query(f"SELECT * EXCLUDE (bucket) FROM ({_SCORED})")
def candidate_score_parts(s, d):
    return _scored(s, d).select("id", "score", *[F.round(f"parts.{n}", 9).alias(n) for n in I.SCORE])


@query(f"SELECT bucket, count(*) AS n FROM ({_SCORED}) GROUP BY 1")
def year_bucket_counts(s, d):
    return _scored(s, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH q AS (SELECT * FROM (VALUES ('early', 8, 10), ('middle', 20, 25), ('late', 35, 40)) AS v(bucket, lo, hi)), x AS (SELECT s.id, s.bucket, s.score, lo, hi, row_number() OVER (PARTITION BY s.bucket ORDER BY score DESC, id) AS rn FROM ({_SCORED}) s LEFT JOIN q ON q.bucket = s.bucket), y AS (SELECT *, CASE WHEN rn <= coalesce(lo, 0) THEN 0 WHEN hi IS NULL OR rn <= hi THEN 1 ELSE 2 END AS class FROM x), z AS (SELECT *, row_number() OVER (ORDER BY class, score DESC, id) AS g FROM y) SELECT id, bucket, score, class::BIGINT AS class FROM z WHERE class = 0 OR g <= 70")
def quota_selection(s, d):
    return I.quota_selection(_scored(s, d).select("id", "bucket", "score"), s.createDataFrame(W.QUOTAS, "bucket string, lo int, hi int"), 70)


@query(with_("pb vocab", "SELECT lower(alias) AS alias, array_to_string(list_sort(list(DISTINCT entity)), ',') AS owners FROM vocab GROUP BY 1"))
def alias_owner_index(s, d):
    return W.vocabulary(s, d).groupBy(F.lower("alias").alias("alias")).agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("owners"))


@query(with_("pb vocab", "SELECT 'VOCAB_UNDECLARED_AMBIGUITY' AS code, alias AS location, 'ERROR' AS severity FROM (SELECT lower(alias) AS alias, count(DISTINCT entity) AS n FROM vocab GROUP BY 1) WHERE n > 1 AND alias <> 'small'"))
def undeclared_ambiguity(s, d):
    declared = s.createDataFrame([("Small", ["technique:small", "concept:small"])], "alias string, candidates array<string>")
    return V.undeclared_ambiguity(W.vocabulary(s, d), declared)


_SENT = "(SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents))"


@query(with_("alias", f"SELECT 'doc:' || doc_id AS source, 'USES' AS relation, entity AS target, arg_min(sentence, pos) AS fragment FROM {_SENT}, alias WHERE type IN ('method', 'technique') AND {_MATCH.format(t='sentence')} GROUP BY doc_id, entity HAVING count(*) FILTER (WHERE regexp_matches(lower(sentence), '(^|[^a-z0-9_])(in|de|der)($|[^a-z0-9_])')) > 0"))
def rule_edges_usage(s, d):
    papers = docs(s, d).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    out = U.rule_edges(papers, W.aliases(s), {"use": r"(^|[^A-Za-z0-9_])(?:in|de|der)($|[^A-Za-z0-9_])"}, tuple(r for r in U.RULES if r.relation == "USES"))
    return out.select("source", "relation", "target", F.col("evidence").alias("fragment"))


@query(with_("alias", f"SELECT 'doc:' || doc_id AS source, entity AS target, rule FROM documents, alias, (VALUES ('ADDRESSES', 'concept'), ('PROPOSES', 'method')) AS r(rule, t) WHERE type = t AND {_MATCH.format(t='text')} AND (rule <> 'ADDRESSES' OR entity NOT IN (SELECT a.entity FROM alias a JOIN (SELECT lower(alias) AS l FROM alias GROUP BY 1 HAVING count(DISTINCT entity) > 1) o ON lower(a.alias) = l WHERE a.alias_ord = 1)) GROUP BY ALL").replace("rule FROM", "rule AS relation FROM"))
def rule_edges_title(s, d):
    papers = docs(s, d).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("title"), F.lit("").alias("abstract"))
    out = U.rule_edges(papers, W.aliases(s), CUES, tuple(r for r in U.RULES if r.relation in ("ADDRESSES", "PROPOSES")))
    return out.select("source", "target", "relation")


@query(with_("alias", f"SELECT x.doc_id AS id, x.entity AS a, y.entity AS b, min(x.pos)::BIGINT AS pos FROM (SELECT DISTINCT doc_id, pos, entity FROM {_SENT}, alias WHERE {_MATCH.format(t='sentence')}) x JOIN (SELECT DISTINCT doc_id, pos, entity FROM {_SENT}, alias WHERE {_MATCH.format(t='sentence')}) y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.entity <> y.entity GROUP BY 1, 2, 3"))
def cooccurrence_edges(s, d):
    hits = U.term_matches(U.sentence_rows(docs(s, d).select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("sentence", "text"), W.aliases(s))
    return U.cooccurrences(hits, hits)


@query(with_("lp", "SELECT source, 'PROPOSES' AS relation, 'method:' || noun AS target, min(l_linenumber)::BIGINT AS ord, count(*) - 1 AS corroborating FROM lp GROUP BY 1, 2, 3"))
def edge_dedup_corroboration(s, d):
    rows = W.line_parts(s, d).select(W.paper_id("l_orderkey").alias("source"), F.lit("PROPOSES").alias("relation"), F.concat(F.lit("method:"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("target"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("provenance"))
    return U.accumulate(rows).select("source", "relation", "target", "ord", "corroborating")


@query(with_("lp edge", "SELECT printf('edge_%04d', row_number() OVER (ORDER BY source, relation, target)) AS edge_id, source, relation, target FROM edge"))
def edge_ids(s, d):
    return U.number(W.edges(s, d), ["source", "relation", "target"]).select("edge_id", "source", "relation", "target")


@query(with_("lp edge", "SELECT relation, split_part(target, ':', 1) AS kind, count(*) AS n FROM edge GROUP BY 1, 2"))
def relation_distribution(s, d):
    return W.edges(s, d).groupBy("relation", F.split_part("target", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


_BAD = [("paper:o_1", "PROPOSES", "method:missing"), ("paper:none", "USES", "technique:missing"), ("method:a", "ADDRESSES", "paper:o_1"), ("method:a", "USES", "method:a"), ("paper:o_1", "CITED_BY", "paper:o_2"), ("method:b", "COMPARES_WITH", "method:a"), ("method:a", "EXTENDS", "method:b"), ("method:b", "EXTENDED_BY", "method:a"), ("paper:o_1", "PROPOSES", "method:missing")]
_BADSQL = "bad AS (SELECT * FROM (VALUES " + W._values(_BAD) + ") AS v(source, relation, target)), every AS (SELECT source, relation, target FROM edge UNION ALL SELECT * FROM bad)"


def _with_bad(s, d):
    return W.edges(s, d).unionByName(s.createDataFrame(_BAD, "source string, relation string, target string"))


_T = "source || '|' || relation || '|' || target"


@query(with_("lp edge pb vocab", f", {_BADSQL}, ids AS (SELECT entity AS id FROM vocab UNION SELECT 'paper:o_' || o_orderkey FROM orders) SELECT DISTINCT 'EDGE_UNKNOWN_ENDPOINT' AS code, {_T} AS location, 'ERROR' AS severity FROM every WHERE source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids)").replace(") , bad", "), bad"))
def validate_unknown_endpoint(s, d):
    ids = W.vocabulary(s, d).select(F.col("entity").alias("id")).union(W.table(s, d, "orders").select(W.paper_id("o_orderkey")))
    return V.unknown_endpoints(_with_bad(s, d), ids)


_SPEC = [("PROPOSES", ["paper"], ["method"], "ACTIVE"), ("USES", ["paper", "method"], ["method", "technique"], "ACTIVE"), ("ADDRESSES", ["paper"], ["concept", "problem"], "ACTIVE"), ("COMPARES_WITH", ["method"], ["method"], "ACTIVE"), ("CITED_BY", ["paper"], ["paper"], "DERIVED_INVERSE")]


@query(with_("lp edge pb vocab", f", {_BADSQL}, ids AS (SELECT entity AS id, split_part(entity, ':', 1) AS type FROM vocab UNION SELECT 'paper:o_' || o_orderkey, 'paper' FROM orders UNION SELECT * FROM (VALUES ('method:a', 'method'), ('method:b', 'technique'), ('method:missing', 'method')) AS v(id, type)), t AS (SELECT e.*, {_T} AS loc, x.type AS st, y.type AS tt FROM every e LEFT JOIN ids x ON x.id = source LEFT JOIN ids y ON y.id = target) SELECT 'EDGE_RELATION_NOT_STORABLE' AS code, loc AS location, 'ERROR' AS severity FROM t WHERE relation IN ('CITED_BY', 'EXTENDS', 'EXTENDED_BY') UNION ALL SELECT 'EDGE_SELF_LOOP', loc, 'ERROR' FROM t WHERE relation NOT IN ('CITED_BY', 'EXTENDS', 'EXTENDED_BY') AND source = target UNION ALL SELECT 'EDGE_DOMAIN', loc, 'ERROR' FROM t WHERE tt IS NOT NULL AND ((relation IN ('PROPOSES', 'ADDRESSES') AND st <> 'paper') OR (relation = 'USES' AND st NOT IN ('paper', 'method')) OR (relation = 'COMPARES_WITH' AND st <> 'method')) UNION ALL SELECT 'EDGE_RANGE', loc, 'ERROR' FROM t WHERE st IS NOT NULL AND ((relation = 'PROPOSES' AND tt <> 'method') OR (relation = 'USES' AND tt NOT IN ('method', 'technique')) OR (relation = 'ADDRESSES' AND tt NOT IN ('concept', 'problem')) OR (relation = 'COMPARES_WITH' AND tt <> 'method'))").replace(") , bad", "), bad"))
def validate_domain_range(s, d):
    own = W.vocabulary(s, d).select(F.col("entity").alias("id"), "type").union(W.table(s, d, "orders").select(W.paper_id("o_orderkey"), F.lit("paper")))
    more = s.createDataFrame([("method:a", "method"), ("method:b", "technique"), ("method:missing", "method")], "id string, type string")
    return V.domain_range(_with_bad(s, d), s.createDataFrame(_SPEC, "relation string, domain array<string>, range array<string>, status string"), own.union(more).distinct())


@query(with_("lp edge", f", {_BADSQL} SELECT 'EDGE_DUP_TRIPLE' AS code, {_T} AS location, 'ERROR' AS severity FROM every GROUP BY source, relation, target HAVING count(*) > 1"))
def validate_duplicates(s, d):
    return V.duplicates(_with_bad(s, d), ["source", "relation", "target"], "EDGE_DUP_TRIPLE")


@query(with_("lp edge", f", {_BADSQL} SELECT 'EDGE_SYMMETRIC_ORDER' AS code, {_T} AS location, 'ERROR' AS severity FROM every WHERE relation = 'COMPARES_WITH' AND source > target UNION ALL SELECT 'EDGE_MIRROR_CONFLICT', {_T}, 'ERROR' FROM every e WHERE relation = 'EXTENDS' AND EXISTS (SELECT 1 FROM every m WHERE m.relation = 'EXTENDED_BY' AND m.source = e.target AND m.target = e.source)"))
def validate_symmetric_mirror(s, d):
    return V.symmetric_mirror(_with_bad(s, d), ["COMPARES_WITH"], {"EXTENDS": "EXTENDED_BY"})


@query(with_("lp", "SELECT DISTINCT 'EDGE_ATTRIBUTION_INCONSISTENT' AS code, 'method:' || noun || '|REPORTS_LIMITATION|limitation:l' || l_linenumber AS location, 'ERROR' AS severity FROM lp WHERE l_linenumber % 2 = 0"))
def validate_attribution(s, d):
    lp = W.line_parts(s, d).select(W.paper_id("l_orderkey").alias("paper"), F.concat(F.lit("method:"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("m"), "l_linenumber")
    proposes = lp.select(F.col("paper").alias("source"), F.lit("PROPOSES").alias("relation"), F.col("m").alias("target"), F.col("paper").alias("source_paper"), F.lit(None).cast("string").alias("attribution"))
    limits = lp.select(F.col("m").alias("source"), F.lit("REPORTS_LIMITATION").alias("relation"), F.concat(F.lit("limitation:l"), F.col("l_linenumber").cast("string")).alias("target"), F.col("paper").alias("source_paper"), F.when(F.col("l_linenumber") % 2 == 1, "SELF_REPORTED").otherwise("EXTERNAL").alias("attribution"))
    return V.attribution(proposes.unionByName(limits)).distinct()


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash_rows(s, d):
    return docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha"))


_Q = "paper cites lp edge pb vocab proposal grounded cand degree scored ranked"


def analysis(s, d, edges=None) -> R.Analysis:
    """One batch of proposals over the test tables."""
    return R.Analysis(W.proposals(s), W.vocabulary(s, d), W.edges(s, d) if edges is None else edges, W.paper(s, d), W.cites(s, d), W.NOW, W.declared(s))


@query(with_("pb vocab proposal grounded", "SELECT request_id, entity, type, alias, status FROM grounded"))
def ground_proposals(s, d):
    return analysis(s, d).grounded


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(with_("pb vocab proposal grounded", f", piece AS (SELECT request_id, unnest(string_split(lower(v.alias), ' ')) AS w FROM (SELECT request_id, entity FROM grounded WHERE status = 'MATCHED' UNION SELECT g.request_id, o.entity FROM grounded g JOIN vocab o ON lower(o.alias) = lower(g.alias) WHERE g.status = 'AMBIGUOUS') k JOIN vocab v ON v.entity = k.entity), word AS (SELECT request_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{4,}}'))) AS w FROM proposal), kept AS (SELECT request_id, list(w ORDER BY w)[1:5] AS ws FROM word x WHERE lower(w) NOT IN ({_STOP}) AND NOT EXISTS (SELECT 1 FROM piece p WHERE p.request_id = x.request_id AND p.w = lower(x.w)) GROUP BY 1) SELECT p.request_id, array_to_string(coalesce(ws, CASE WHEN p.request_id IN (SELECT request_id FROM grounded WHERE status = 'MATCHED') THEN []::VARCHAR[] ELSE [coalesce(nullif(substr(trim(text), 1, 64), ''), 'empty_input')] END), '|') AS unknown FROM proposal p LEFT JOIN kept k ON k.request_id = p.request_id").replace(") , piece", "), piece"))
def proposal_unknown_terms(s, d):
    return analysis(s, d).unknown.select("request_id", F.array_join("unknown", "|").alias("unknown"))


@query(with_("lp edge pb vocab proposal grounded cand", "SELECT request_id, count(DISTINCT paper) AS papers, count(*) AS pairs, sum(n_edges)::BIGINT AS edges FROM cand GROUP BY 1"))
def candidate_retrieval(s, d):
    a = analysis(s, d)
    return R.candidates(a.grounded, a.edges).groupBy("request_id").agg(F.count_distinct("paper").alias("papers"), F.count("*").alias("pairs"), F.sum("n_edges").alias("edges"))


@query(with_(_Q, "SELECT request_id, rank, paper, score, n_matched, n_evidence, CASE WHEN score >= CAST(0.65 AS DOUBLE) AND n_evidence >= 2 THEN 'HIGH' WHEN score >= CAST(0.4 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ranked"))
def prior_work_top10(s, d):
    a = analysis(s, d)
    return R.ranked(R.scored(a.grounded, a.candidates, a.papers, a.cites, a.now))


@query(with_(_Q, ", all_ AS (SELECT request_id, paper, count(*) AS n, string_agg(entity, ', ' ORDER BY entity) AS names FROM cand GROUP BY 1, 2) SELECT k.request_id, rank, k.paper, 'shares ' || n || ' grounded vocabulary entries with proposal' AS reason, names AS concepts_learned, 'Useful because it has typed edges to ' || names AS relationship_to_proposal FROM ranked k JOIN all_ a ON a.request_id = k.request_id AND a.paper = k.paper WHERE rank <= 7").replace(") , all_", "), all_"))
def reading_path_top7(s, d):
    return analysis(s, d).reading_path


@query(with_(_Q, "SELECT request_id, n, paper, entity, relation FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, r) AS n FROM (SELECT k.request_id, k.rank, k.paper, e.entity, e.relation, row_number() OVER (PARTITION BY k.request_id, k.paper ORDER BY e.entity, e.relation) AS r FROM ranked k JOIN (SELECT source AS paper, target AS entity, relation FROM edge UNION ALL SELECT target, source, relation FROM edge) e ON e.paper = k.paper JOIN grounded g ON g.request_id = k.request_id AND g.entity = e.entity AND g.status = 'MATCHED' WHERE k.rank <= 5) WHERE r <= 3) WHERE n <= 10"))
def evidence_capped(s, d):
    return analysis(s, d).evidence


_POS = "SELECT p.request_id, CASE WHEN coalesce(n_match, 0) = 0 OR coalesce(n_cand, 0) = 0 THEN 'UNKNOWN' WHEN top >= CAST(0.65 AS DOUBLE) AND cov >= CAST(0.6 AS DOUBLE) THEN 'WELL_EXPLORED' WHEN cov < 1 AND n_cand <= 2 THEN 'UNDERREPRESENTED' WHEN top >= CAST(0.4 AS DOUBLE) THEN 'PARTIALLY_EXPLORED' ELSE 'UNKNOWN' END AS label, CASE WHEN coalesce(n_match, 0) = 0 OR coalesce(n_cand, 0) = 0 THEN 'INSUFFICIENT' WHEN top >= CAST(0.65 AS DOUBLE) AND cov >= CAST(0.6 AS DOUBLE) THEN (CASE WHEN n_cand >= 2 THEN 'HIGH' ELSE 'MEDIUM' END) WHEN cov < 1 AND n_cand <= 2 THEN (CASE WHEN n_cand = 1 THEN 'LOW' ELSE 'MEDIUM' END) WHEN top >= CAST(0.4 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS sufficiency, coalesce(n_match, 0) = 0 OR coalesce(n_cand, 0) = 0 AS abstain, coalesce(n_cand, 0) AS n_candidates, coalesce(top, 0) AS confidence_score FROM proposal p LEFT JOIN (SELECT request_id, count(*) AS n_match FROM grounded WHERE status = 'MATCHED' GROUP BY 1) m ON m.request_id = p.request_id LEFT JOIN (SELECT c.request_id, count(*) AS n_cand, max(n / CAST(u AS DOUBLE)) AS cov FROM (SELECT request_id, paper, count(*) AS n FROM cand GROUP BY 1, 2) c JOIN (SELECT request_id, count(*) AS u FROM grounded WHERE status = 'MATCHED' GROUP BY 1) u ON u.request_id = c.request_id GROUP BY 1) c ON c.request_id = p.request_id LEFT JOIN (SELECT request_id, score AS top FROM ranked WHERE rank = 1) t ON t.request_id = p.request_id"


@query(with_(_Q, _POS))
def facet_positioning(s, d):
    return analysis(s, d).positions


@query(with_(_Q, f", pos AS ({_POS}) SELECT p.request_id, array_to_string(list_filter([CASE WHEN abstain THEN '{R.INSUFFICIENT}' END, CASE WHEN coalesce(n_match, 0) = 0 THEN '{R.NOTHING_KNOWN}' END, '{R.AMBIGUOUS_TERMS}' || doubt], lambda x: x IS NOT NULL), ' | ') AS warnings FROM pos p LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE status = 'MATCHED') AS n_match, string_agg(DISTINCT CASE WHEN status = 'AMBIGUOUS' THEN lower(alias) END, ', ' ORDER BY CASE WHEN status = 'AMBIGUOUS' THEN lower(alias) END) AS doubt FROM grounded GROUP BY 1) g ON g.request_id = p.request_id").replace(") , pos", "), pos"))
def request_warnings(s, d):
    return analysis(s, d).warnings


_RUNGS = {"L0": ("citation",), "L1": ("proximity", "citation"), "L2": tuple(R.WEIGHTS)}


@query(with_(_Q, ", rung AS (SELECT request_id, paper, unnest(['L0', 'L1', 'L2']) AS rung, unnest([CAST(0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f_citation, CAST(0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f_citation, CAST(0 AS DOUBLE) + CAST(0.3 AS DOUBLE) * f_concept + CAST(0.2 AS DOUBLE) * f_method + CAST(0.15 AS DOUBLE) * f_problem + CAST(0.1 AS DOUBLE) * CAST(0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f_citation + CAST(0.05 AS DOUBLE) * f_temporal]) AS score FROM scored) SELECT rung, request_id, arg_min(paper, (-score, paper)) AS paper, max(score) AS score, CASE WHEN max(score) >= CAST(0.65 AS DOUBLE) THEN 'WELL_EXPLORED' WHEN max(score) >= CAST(0.4 AS DOUBLE) THEN 'PARTIALLY_EXPLORED' WHEN max(score) > 0 THEN 'UNDERREPRESENTED' ELSE 'UNKNOWN' END AS label FROM rung GROUP BY 1, 2").replace(") , rung", "), rung"))
def ablation_ladder(s, d):
    a = analysis(s, d)
    return E.ablation(a.grounded, a.candidates, a.papers, a.cites, a.now, _RUNGS)


@query("WITH RECURSIVE " + W.CTE["cites"] + ", both_ AS (SELECT a, b FROM cites UNION SELECT b, a FROM cites), w(seed, id, distance) AS (SELECT s, s, 0 FROM (VALUES ('paper:o_1'), ('paper:o_7'), ('paper:o_100')) AS v(s) UNION SELECT w.seed, e.b, w.distance + 1 FROM w JOIN both_ e ON w.id = e.a WHERE w.distance < 3) SELECT seed, id, min(distance)::BIGINT AS distance FROM w GROUP BY 1, 2")
def bounded_distance(s, d):
    return G.bounded_distance(W.cites(s, d), s.createDataFrame([("paper:o_1",), ("paper:o_7",), ("paper:o_100",)], "seed string"))


@query("WITH RECURSIVE " + W.CTE["cites"] + ", both_ AS (SELECT a, b FROM cites UNION SELECT b, a FROM cites), w(seed, id, distance) AS (SELECT s, s, 0 FROM (VALUES ('paper:o_1'), ('paper:o_7'), ('paper:o_100')) AS v(s) UNION SELECT w.seed, e.b, w.distance + 1 FROM w JOIN both_ e ON w.id = e.a WHERE w.distance < 3) SELECT seed, id, distance FROM (SELECT seed, id, min(distance)::BIGINT AS distance FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, id) <= 3")
def bounded_distance_capped(s, d):
    return G.bounded_distance(W.cites(s, d), s.createDataFrame([("paper:o_1",), ("paper:o_7",), ("paper:o_100",)], "seed string"), most=3)


_STEPS = [("concept:a", "concept:b"), ("concept:b", "concept:c"), ("concept:a", "concept:c"), ("concept:c", "method:d"), ("technique:x", "technique:y"), ("technique:y", "technique:x"), ("technique:y", "technique:z")]
_PRE = "pre AS (SELECT DISTINCT 'method:' || noun AS source, 'technique:' || adj AS target FROM lp UNION SELECT * FROM (VALUES " + W._values(_STEPS[:4]) + ") AS v(source, target))"


def _prerequisites(s, d):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    own = W.line_parts(s, d).select(F.concat(F.lit("method:"), word(2)).alias("source"), F.concat(F.lit("technique:"), word(1)).alias("target")).distinct()
    return own.union(s.createDataFrame(_STEPS[:4], "source string, target string"))


@query("WITH RECURSIVE " + W.CTE["lp"] + ", " + _PRE + ", c(before, after, depth) AS (SELECT source, target, 1 FROM pre UNION SELECT c.before, p.target, c.depth + 1 FROM c JOIN pre p ON p.source = c.after WHERE c.depth < 8) SELECT before, after, max(depth)::BIGINT AS depth FROM c GROUP BY 1, 2")
def prerequisite_chains(s, d):
    return G.prerequisite_chains(_prerequisites(s, d))


@query("WITH RECURSIVE e AS (SELECT * FROM (VALUES " + W._values(_STEPS) + ") AS v(source, target)), c(before, after) AS (SELECT source, target FROM e UNION SELECT c.before, e.target FROM c JOIN e ON e.source = c.after) SELECT DISTINCT before AS entry FROM c WHERE before = after")
def prerequisite_cycles(s, d):
    return G.prerequisite_cycles(s.createDataFrame(_STEPS, "source string, target string"))


@query(with_("lp edge", "SELECT target AS neighbour, relation, 'out' AS direction FROM edge WHERE source = 'paper:o_7' UNION ALL SELECT source, relation, 'in' FROM edge WHERE target = 'paper:o_7'"))
def neighbors(s, d):
    return G.neighbours(W.edges(s, d), F.lit("paper:o_7"))


@query(with_("lp edge", "SELECT source, relation, target FROM edge WHERE source = 'method:ring' OR target = 'method:ring'"))
def entity_edges(s, d):
    return G.filter_edges(W.edges(s, d), node="method:ring")


@query(with_("lp edge", "SELECT source, relation, target FROM edge WHERE relation = 'ADDRESSES' AND target = 'concept:promo'"))
def edge_filter(s, d):
    return G.filter_edges(W.edges(s, d), relation="ADDRESSES", target="concept:promo")


@query(with_("cites", "SELECT b AS source, 'CITED_BY' AS relation, a AS target FROM cites"))
def cited_by_view(s, d):
    return W.cites(s, d).select(F.col("b").alias("source"), F.lit("CITED_BY").alias("relation"), F.col("a").alias("target"))


_CLAIMS = "(SELECT source AS claim, doc_id AS paper, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTS' WHEN toxic = 1 THEN 'CHALLENGES' END AS side FROM documents JOIN labels USING (doc_id))"


def _claims(s, d):
    side = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS").when(F.col("toxic") == 1, "CHALLENGES")
    return docs(s, d).select("doc_id", "source").join(W.table(s, d, "labels"), "doc_id").select(F.col("source").alias("claim"), F.col("doc_id").alias("paper"), side.alias("side"))


@query(f"SELECT claim, count(*) FILTER (WHERE side = 'SUPPORTS') AS n_support, count(*) FILTER (WHERE side = 'CHALLENGES') AS n_challenge, count(DISTINCT paper) AS n_papers, CASE WHEN count(*) FILTER (WHERE side = 'SUPPORTS') > 0 AND count(*) FILTER (WHERE side = 'CHALLENGES') > 0 AND count(DISTINCT paper) >= 2 THEN 'CONFLICTING' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM {_CLAIMS} WHERE side IS NOT NULL GROUP BY 1")
def tensions(s, d):
    return R.tensions(_claims(s, d))


@query(with_("lp", "SELECT DISTINCT source AS paper, 'method:' || noun AS method, 'limitation:l' || l_linenumber AS limitation FROM lp"))
def limitations_report(s, d):
    return W.line_parts(s, d).select(W.paper_id("l_orderkey").alias("paper"), F.concat(F.lit("method:"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("method"), F.concat(F.lit("limitation:l"), F.col("l_linenumber").cast("string")).alias("limitation")).distinct()


_J = "(SELECT quality AS gold, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS predicted, 1 + doc_id % 3 AS weight FROM documents JOIN labels USING (doc_id))"


@query(f"WITH j AS {_J}, g AS (SELECT gold AS class, sum(weight)::BIGINT AS support, sum(CASE WHEN gold = predicted THEN weight ELSE 0 END)::BIGINT AS tp FROM j GROUP BY 1), p AS (SELECT predicted AS class, sum(weight)::BIGINT AS said FROM j GROUP BY 1) SELECT g.class::BIGINT AS class, support, tp, coalesce(said, 0) AS said, CAST(2 AS DOUBLE) * tp / (support + coalesce(said, 0)) AS f1 FROM g LEFT JOIN p ON p.class = g.class")
def metric_macro_f1(s, d):
    j = docs(s, d).join(W.table(s, d, "labels"), "doc_id").select(F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("predicted"), (1 + F.col("doc_id") % 3).alias("weight"))
    return E.macro_f1(j)


def _judged(s, d):
    ranked = docs(s, d).select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(E.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10")
    gold = docs(s, d).select(F.col("source").alias("request_id"), F.col("doc_id").alias("item")).join(W.table(s, d, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") + F.col("quality") * (1 - F.col("toxic"))).alias("relevance")), "item")
    return ranked.select(F.col("source").alias("request_id"), F.col("doc_id").alias("item"), "rank"), gold


_RG = "ranked AS (SELECT source AS request_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10), gold AS (SELECT source AS request_id, doc_id AS item, quality + quality * (1 - toxic) AS relevance FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_RG}, best AS (SELECT request_id, relevance, row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC, item) AS rank FROM gold), i AS (SELECT request_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list((pow(2, relevance) - 1) / log2(rank + 1) ORDER BY rank)), lambda x, y: x + y) AS v FROM best WHERE rank <= 5 GROUP BY 1), g AS (SELECT r.request_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1) ORDER BY rank)), lambda x, y: x + y) AS v FROM ranked r LEFT JOIN gold USING (request_id, item) WHERE rank <= 5 GROUP BY 1) SELECT i.request_id, round(coalesce(g.v, 0) / i.v, 9) AS ndcg FROM i LEFT JOIN g USING (request_id) WHERE i.v > 0")
def metric_ndcg5(s, d):
    return E.ndcg(*_judged(s, d)).select("request_id", F.round("ndcg", 9).alias("ndcg"))


@query(f"WITH {_RG}, h AS (SELECT r.request_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first FROM ranked r JOIN gold g USING (request_id, item) WHERE relevance > 0 GROUP BY 1) SELECT t.request_id, coalesce(hits, 0) / CAST(5 AS DOUBLE) AS p_at_k, coalesce(hits, 0) / CAST(n AS DOUBLE) AS r_at_k, coalesce(CAST(1 AS DOUBLE) / first, CAST(0 AS DOUBLE)) AS rr FROM (SELECT request_id, count(*) AS n FROM gold WHERE relevance > 0 GROUP BY 1) t LEFT JOIN h USING (request_id)")
def metric_p_r_mrr(s, d):
    return E.precision_recall_mrr(*_judged(s, d))


@query("SELECT confidence, covered::BIGINT AS covered, errors::BIGINT AS errors, errors / CAST(covered AS DOUBLE) AS risk FROM (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS covered, sum(w) OVER (ORDER BY confidence DESC) AS errors FROM (SELECT n_chars // 100 AS confidence, count(*) AS n, sum(1 - quality) AS w FROM documents JOIN labels USING (doc_id) GROUP BY 1))")
def risk_coverage(s, d):
    j = docs(s, d).join(W.table(s, d, "labels"), "doc_id").select(F.floor(F.col("n_chars") / 100).alias("confidence"), (1 - F.col("quality")).alias("wrong"))
    return E.risk_coverage(j)


_TS = "(SELECT DISTINCT source AS facet, lang AS claim, CASE WHEN {c} THEN 'CONFLICTING' ELSE 'CONSISTENT' END AS status FROM documents JOIN labels USING (doc_id))"


@query(f"WITH g AS {_TS.format(c='toxic = 1')}, f AS {_TS.format(c='quality = 0')}, n AS (SELECT count(*) FILTER (WHERE g.facet IS NOT NULL AND f.facet IS NOT NULL) AS tp, count(g.facet) AS n_gold, count(f.facet) AS n_found FROM g FULL JOIN f ON g.facet = f.facet AND g.claim = f.claim AND g.status = f.status) SELECT tp, n_gold, n_found, tp / CAST(n_found AS DOUBLE) AS precision, tp / CAST(n_gold AS DOUBLE) AS recall, CAST(2 AS DOUBLE) * tp / (n_gold + n_found) AS f1 FROM n")
def tension_prf(s, d):
    rows = docs(s, d).join(W.table(s, d, "labels"), "doc_id")
    of = lambda c: rows.select(F.col("source").alias("facet"), F.col("lang").alias("claim"), F.when(c, "CONFLICTING").otherwise("CONSISTENT").alias("status"))
    return E.tension_prf(of(F.col("toxic") == 1), of(F.col("quality") == 0))


@query("WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), q AS (SELECT id AS request_id, unnest(list_distinct(ws)) AS w FROM t WHERE id % 20 = 0), st AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_words FROM t), p AS (SELECT id, len, w, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS w FROM t) GROUP BY 1, 2, 3), df AS (SELECT w, count(*) AS df FROM p GROUP BY 1), x AS (SELECT q.request_id, p.id, round(sum(ln(1 + (n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len * n_docs / n_words))), 9) AS score FROM p JOIN df USING (w) JOIN q USING (w), st GROUP BY 1, 2) SELECT request_id, rank, id FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank, id FROM x) WHERE rank <= 10")
def bm25_top10(s, d):
    rows = docs(s, d).select(F.col("doc_id").alias("id"), "text")
    return E.bm25(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "request_id"))


@query("WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, rank, id FROM (SELECT q.id AS query_id, x.id, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(x.v, q.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(q.v, q.v)) DESC, x.id) AS rank FROM x, x q WHERE q.id % 20 = 0 AND q.id <> x.id) WHERE rank <= 10")
def cosine_top10(s, d):
    v = W.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return E.cosine_top(v, v.where("id % 20 = 0"))


_GOLD = "CASE WHEN quality = 1 AND toxic = 0 THEN 'WELL_EXPLORED' WHEN quality = 1 THEN 'PARTIALLY_EXPLORED' WHEN toxic = 1 THEN 'UNDERREPRESENTED' ELSE 'UNKNOWN' END"


@query(f"WITH d AS (SELECT coalesce(lang, '?') AS system, {_GOLD} AS gold, n_chars / CAST(1000 AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), g AS (SELECT row_number() OVER (ORDER BY lo, hi) AS cell, lo, hi FROM (SELECT CAST(unnest([0.2, 0.5, 1.0, 2.0]) AS DOUBLE) AS lo), (SELECT CAST(unnest([1.0, 2.0, 5.0]) AS DOUBLE) AS hi) WHERE lo < hi), x AS (SELECT system, cell, lo, hi, gold, CASE WHEN score >= hi THEN 'WELL_EXPLORED' WHEN score >= lo THEN 'PARTIALLY_EXPLORED' WHEN score > 0 THEN 'UNDERREPRESENTED' ELSE 'UNKNOWN' END AS predicted FROM d, g), c AS (SELECT system, cell, lo, hi, gold AS class, count(*) AS support, count(*) FILTER (WHERE gold = predicted) AS tp FROM x GROUP BY ALL), p AS (SELECT system, cell, predicted AS class, count(*) AS said FROM x GROUP BY ALL), f AS (SELECT c.system, c.cell, lo, hi, round(avg(CAST(2 AS DOUBLE) * tp / (support + coalesce(said, 0))), 9) AS macro_f1 FROM c LEFT JOIN p ON c.system = p.system AND c.cell = p.cell AND c.class = p.class GROUP BY ALL) SELECT system, lo, hi, macro_f1 FROM f QUALIFY row_number() OVER (PARTITION BY system ORDER BY macro_f1 DESC, cell) = 1")
def threshold_grid_search(s, d):
    dev = docs(s, d).join(W.table(s, d, "labels"), "doc_id").select(F.coalesce("lang", F.lit("?")).alias("system"), F.expr(_GOLD).alias("gold"), (F.col("n_chars") / 1000).alias("score"))
    return N.grid_search(dev, (0.2, 0.5, 1.0, 2.0), (1.0, 2.0, 5.0))


@query()
def greedy_facet_matching(s, d):
    words = lambda t: F.array_distinct(F.split(F.lower(t), " "))
    a = W.table(s, d, "benchmark").select((F.col("item_id") % 10).alias("proposal"), F.col("item_id").cast("string").alias("gold"), words(F.col("text")).alias("ga"))
    b = a.select("proposal", F.col("gold").alias("system"), F.col("ga").alias("sa"))
    pairs = a.join(b, "proposal").where("gold <> system").withColumn("similarity", F.size(F.array_intersect("ga", "sa")) / F.size(F.array_union("ga", "sa")))
    return E.greedy_matching(pairs, 0.05)


@query()
def paired_bootstrap(s, d):
    diff = docs(s, d).join(W.table(s, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic")).cast("double").alias("d"))
    return E.paired_bootstrap(diff, 2000)


@query(with_("lp edge", ", h AS (SELECT sha256('{\"relation\":\"' || relation || '\",\"source\":\"' || source || '\",\"target\":\"' || target || '\"}') AS h FROM edge), z AS (SELECT CASE WHEN count(*) <= 4096 THEN 0 WHEN count(*) <= 65536 THEN 1 WHEN count(*) <= 1048576 THEN 2 END AS z FROM h), g AS (SELECT substr(h, 1, z) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h, z GROUP BY 1), r AS (SELECT sha256(string_agg(p || ':' || h, '' ORDER BY p || ':' || h)) AS r, min(h) AS leaf FROM g) SELECT CASE WHEN z = 0 THEN leaf ELSE r END AS state_sha256 FROM r, z").replace(") , h AS", "), h AS"))
def knowledge_state_hash(s, d):
    from ..sinks.state import canonical, content_digest

    return content_digest(canonical(W.edges(s, d).select("relation", "source", "target"))).select(F.col("sha256").alias("state_sha256"))


from . import checks, knowledge  # noqa: E402, F401  their queries register themselves
