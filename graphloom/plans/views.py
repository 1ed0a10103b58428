"""Deterministic views of the test tables as papers, citations, edges, vocabulary and proposals; the same in SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

PROPOSALS = [(1, "A small ring method for economy problems under Brand#2"), (2, "large  bolt"), (3, "nothing that is known here"), (4, ""), (5, "Red Bolt and blue ring, PROMO, or Brand#21"), (6, "standard"), (7, "medium nut; green-ring or plate (Brand#7)")]
ALIASES = [("concept:function", "concept", "that", 1), ("concept:function", "concept", "with", 2), ("method:pour", "method", "pour", 1), ("method:und", "method", "und", 1), ("concept:los", "concept", "los", 1), ("technique:los", "technique", "los", 1)]
NOW = 2001
#: Aliases that are declared ambiguous: with several owners they are not resolved.
DECLARED = [("Small",), (" large ",), ("nowhere",)]
LIMITATIONS = [("limitation:cold_start", "limitation", "cold start", "slow start"), ("limitation:drift", "limitation", "drift", "")]
#: Title and abstract of a paper by its key modulo the number of templates: n, a noun and adjective of its first part, m noun of its last, c type, b brand, p priority.
TEMPLATES = [
    ("{n} and {c}", "We propose the {n} for {c} tasks. However, the {n} has one limitation: cold start. We use a {a} step."),
    ("Notes on {b}", "The {m} is limited by drift. We compare it with the {n} on {p}. Performance on {p} is reported."),
    ("Untitled", "In this study we evaluate {c} parts of {b}! The {a} {n} beats the {m}."),
    ("{a} design", None),
    ("", "We build a {n} against {m}?\nWe employ {a} parts. Ablation of {p} and {b} fails to end."),
    ("Report", "Nothing is said here about {n}s or slow start. A limitation is a limitation."),
    ("x", "We introduce {n}. We introduce {n} again with {m}s versus {n}. Trade-off: {m} meets drift."),
    ("{m} or {n}", "Tradeoff: {n} meets drift and cold start. A shortcoming of {m}s is drift, limited to {p}."),
]
QUOTAS = [("early", 8, 10), ("middle", 20, 25), ("late", 35, 40)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def paper_id(c: str) -> F.Column:
    return F.concat(F.lit("paper:o_"), F.col(c).cast("string"))


def paper(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(paper_id("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("seed"), F.coalesce("n", F.lit(0)).cast("long").alias("citation_count"), (F.col("o_orderkey") % 7).cast("long").alias("reference_count"))


def cites(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", before.alias("p")).where("p IS NOT NULL").select(paper_id("o_orderkey").alias("a"), paper_id("p").alias("b"))


def line_parts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))


def _pair(relation: str, target: F.Column) -> F.Column:
    return F.struct(F.lit(relation).alias("relation"), target.alias("target"))


def _entry(kind: str, name: F.Column, alias: F.Column) -> F.Column:
    return F.struct(F.concat(F.lit(f"{kind}:"), name).alias("entity"), F.lit(kind).alias("type"), alias.alias("alias"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges of papers to the nouns, adjectives, types and brands of their parts: one set of parts' codes is made for each paper, so only short codes of lines are shuffled.

    Parts are looked up by a hash of each range of keys, and lines are dealt by their paper once, ahead of the sets: neither side is sorted.
    """
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    part = table(spark, d, "part").select("p_partkey", word(2).alias("n"), word(1).alias("a"), F.lower("p_type").alias("c"), T.slug(F.col("p_brand")).alias("b"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    own = lines.select("l_orderkey", "n", "a", "c", "b").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.struct("n", "a", "c", "b")).alias("parts"))
    each = lambda c, relation, kind: F.array_distinct(F.transform(F.filter("parts", lambda x: x[c].isNotNull()), lambda x: _pair(relation, F.concat(F.lit(f"{kind}:"), x[c]))))
    pairs = F.concat(each("n", "PROPOSES", "method"), each("a", "USES", "technique"), each("c", "ADDRESSES", "concept"), each("b", "ADDRESSES", "problem"))
    return own.select(paper_id("l_orderkey").alias("source"), F.inline(pairs))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    each = F.array(
        _entry("method", word(2), word(2)), _entry("technique", word(1), word(1)),
        _entry("concept", F.lower("p_type"), F.col("p_type")), _entry("problem", T.slug(F.col("p_brand")), F.col("p_brand")),
    )
    return table(spark, d, "part").select(F.inline(each)).distinct().withColumn("alias_ord", F.lit(1))


def proposals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROPOSALS, "request_id long, text string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "entity string, type string, alias string, alias_ord int")


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECLARED, "alias string")


def _spelled(template: str | None) -> str:
    """A template as an SQL expression that both engines read."""
    if template is None:
        return "CAST(NULL AS STRING)"
    parts = [f"'{x}'" if k % 2 == 0 else f"{x}" for k, x in enumerate(re.split(r"[{}]", template.replace("'", "''"))) if x or k % 2]
    return " || ".join(parts) or "''"


def _case(which: int) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN {_spelled(t[which])}" for i, t in enumerate(TEMPLATES)) + " END"


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    """(id, paper_ord, title, abstract, year, venue, authors) of invented papers in English, one for each order."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    end = lambda f, name: f(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias(name)
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(end(F.min, "k1"), end(F.max, "k2"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("venue")).join(ends, F.col("k") == F.col("l_orderkey"), "left")
    one = part.select(F.col("p_partkey").alias("k1"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("n"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.lower("p_type").alias("c"), F.col("p_brand").alias("b"))
    two = part.select(F.col("p_partkey").alias("k2"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("m"))
    told = rows.join(one, "k1", "left").join(two, "k2", "left")
    return told.select(paper_id("k").alias("id"), F.col("k").alias("paper_ord"), F.expr(_case(0)).alias("title"), F.expr(_case(1)).alias("abstract"), "year", "venue", F.when(F.col("k") % 5 != 0, F.array("p")).alias("authors"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary file of those papers: entity, type, label, aliases, status, approval and order; brands that end in 1 are drafts."""
    plain = vocabulary(spark, d).select("entity", "type", F.col("alias").alias("label"), F.when(F.col("type") == "method", F.concat("alias", F.lit("s"))).otherwise("").alias("more"))
    marks = table(spark, d, "orders").select(F.concat(F.lit("benchmark:"), T.slug(F.col("o_orderpriority"))).alias("entity"), F.lit("benchmark").alias("type"), F.col("o_orderpriority").alias("label"), F.lit("").alias("more")).distinct()
    rows = plain.unionByName(marks).unionByName(spark.createDataFrame(LIMITATIONS, "entity string, type string, label string, more string"))
    status = F.when(F.rlike("entity", F.lit("^problem:.*1$")), "DRAFT").otherwise("APPROVED")
    order = F.row_number().over(Window.orderBy("entity", "label"))  # a controlled vocabulary
    return rows.select("entity", "type", "label", F.filter(F.array("more"), lambda x: x != "").alias("aliases"), status.alias("status"), F.when(status == "APPROVED", "me").alias("approved_by"), F.when(status == "APPROVED", "2026-01-01").alias("approved_on"), order.alias("entry_ord"))


def records(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("rec_ord"), "source", F.substring_index(t, "\n", 1).alias("title"), "lang", F.col("n_chars").alias("size"), F.sha2(t, 256).alias("sha"),
        F.concat(F.col("lang"), F.lit(":"), F.col("n_chars").cast("string")).alias("lenkey"), T.fallback_key(F.substring_index(t, "\n", 1), F.lit(0), F.coalesce("lang", F.lit("?"))).alias("fbk"),
    )


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_ENTRIES = "SELECT entity, type, alias AS label, CASE WHEN type = 'method' THEN alias || 's' ELSE '' END AS more FROM vocab UNION SELECT 'benchmark:' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_'), 'benchmark', o_orderpriority, '' FROM orders UNION SELECT * FROM (VALUES " + _values(LIMITATIONS) + ")"
_CUES = {k: v.replace("'", "''") for k, v in T.CUES.items()}
#: Every run of word characters between marks: a term stands whole in a text where its marked form is a part of the text's (terms begin and end with such characters).
_MARKED = "regexp_replace(lower({x}), '([a-z0-9_]+)', '<\\1>', 'g')"
_HIT = "contains({t}, la)"


def _fired(k: int, kinds: str, cue: str, title: bool) -> str:
    out = f"SELECT id, entity, alias_ord, 1 AS nt, ev, {k} AS r FROM said WHERE type IN ({kinds}) AND c_{cue}"
    return out + (f" UNION ALL SELECT id, entity, alias_ord, 0, ev, {k} FROM headed WHERE type IN ({kinds})" if title else "")


#: The views above as common table expressions.
CTE = {
    "paper": "paper AS (SELECT 'paper:o_' || o_orderkey AS id, year(o_orderdate) AS year, o_orderpriority AS seed, coalesce(n, 0) AS citation_count, o_orderkey % 7 AS reference_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)",
    "cites": "cites AS (SELECT 'paper:o_' || o_orderkey AS a, 'paper:o_' || p AS b FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NOT NULL)",
    "lp": "lp AS (SELECT 'paper:o_' || l_orderkey AS source, l_orderkey, l_linenumber, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_type, p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS brand FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "edge": "edge AS (SELECT source, 'PROPOSES' AS relation, 'method:' || noun AS target FROM lp UNION SELECT source, 'USES', 'technique:' || adj FROM lp UNION SELECT source, 'ADDRESSES', 'concept:' || lower(p_type) FROM lp UNION SELECT source, 'ADDRESSES', 'problem:' || brand FROM lp)",
    "pb": "pb AS (SELECT split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_type, p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS brand FROM part)",
    "vocab": "vocab AS (SELECT 'method:' || noun AS entity, 'method' AS type, noun AS alias FROM pb UNION SELECT 'technique:' || adj, 'technique', adj FROM pb UNION SELECT 'concept:' || lower(p_type), 'concept', p_type FROM pb UNION SELECT 'problem:' || brand, 'problem', p_brand FROM pb)",
    "proposal": f"proposal AS (SELECT * FROM (VALUES {_values(PROPOSALS)}) AS v(request_id, text))",
    "alias": f"alias AS (SELECT * FROM (VALUES {_values(ALIASES)}) AS v(entity, type, alias, alias_ord))",
    "grounded": "grounded AS (SELECT request_id, v.entity, v.type, v.alias, CASE WHEN owners > 1 AND lower(v.alias) IN ('small', 'large', 'nowhere') THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM proposal, vocab v JOIN (SELECT lower(alias) AS la, count(DISTINCT entity) AS owners FROM vocab GROUP BY 1) o ON lower(v.alias) = la WHERE regexp_matches(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '(^|[^a-z0-9_])' || lower(v.alias) || '([^a-z0-9_]|$)'))",
    "cand": "cand AS (SELECT g.request_id, e.paper, g.entity, g.type, count(*) AS n_edges FROM grounded g JOIN (SELECT source AS paper, target AS entity FROM edge UNION ALL SELECT target, source FROM edge) e ON e.entity = g.entity WHERE g.status = 'MATCHED' AND e.paper LIKE 'paper:%' GROUP BY 1, 2, 3, 4)",
    "degree": "degree AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM cites UNION ALL SELECT b FROM cites) GROUP BY 1)",
    "scored": """scored AS (SELECT h.request_id, h.paper, n_matched, n_evidence, CASE WHEN u_c > 0 THEN h_c / CAST(u_c AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_concept, CASE WHEN u_m > 0 THEN h_m / CAST(u_m AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_method,
        CASE WHEN u_p > 0 THEN h_p / CAST(u_p AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_problem, coalesce(degree, 0) / CAST((SELECT max(degree) FROM degree) AS DOUBLE) AS f_citation,
        CASE WHEN year IS NULL THEN CAST(0 AS DOUBLE) WHEN year >= 2001 THEN CAST(1 AS DOUBLE) WHEN year >= 1999 THEN CAST(0.8 AS DOUBLE) WHEN year >= 1996 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS f_temporal
      FROM (SELECT request_id, paper, count(*) FILTER (WHERE type = 'concept') AS h_c, count(*) FILTER (WHERE type = 'method') AS h_m, count(*) FILTER (WHERE type = 'problem') AS h_p, count(*) AS n_matched, sum(n_edges)::BIGINT AS n_evidence FROM cand GROUP BY 1, 2) h
      JOIN (SELECT request_id, count(*) FILTER (WHERE type = 'concept') AS u_c, count(*) FILTER (WHERE type = 'method') AS u_m, count(*) FILTER (WHERE type = 'problem') AS u_p FROM grounded WHERE status = 'MATCHED' GROUP BY 1) u ON u.request_id = h.request_id
      LEFT JOIN degree d ON d.id = h.paper LEFT JOIN paper p ON p.id = h.paper)""",
    "ranked": """ranked AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, paper) AS rank, paper, score, n_matched, n_evidence FROM (
      SELECT *, CAST(0 AS DOUBLE) + CAST(0.3 AS DOUBLE) * f_concept + CAST(0.2 AS DOUBLE) * f_method + CAST(0.15 AS DOUBLE) * f_problem + CAST(0.1 AS DOUBLE) * CAST(0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f_citation + CAST(0.05 AS DOUBLE) * f_temporal AS score FROM scored) QUALIFY rank <= 10)""",
    "rec": "rec AS (SELECT doc_id AS rec_ord, source, split_part(text, chr(10), 1) AS title, lang, n_chars AS size, sha256(text) AS sha, lang || ':' || n_chars AS lenkey, 'title:' || trim(regexp_replace(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ':unknown:' || coalesce(lang, '?') AS fbk FROM documents)",
    "ab": f"""ab AS MATERIALIZED (SELECT 'paper:o_' || k AS id, k AS paper_ord, {_case(0).replace('STRING', 'VARCHAR')} AS title, {_case(1).replace('STRING', 'VARCHAR')} AS abstract, year, venue, CASE WHEN k % 5 <> 0 THEN [p] END AS authors FROM (
      SELECT o_orderkey AS k, o_orderpriority AS p, year(o_orderdate) AS year, o_orderstatus AS venue, split_part(x.p_name, ' ', 2) AS n, split_part(x.p_name, ' ', 1) AS a, lower(x.p_type) AS c, x.p_brand AS b, split_part(y.p_name, ' ', 2) AS m FROM orders
      LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS k1, arg_max(l_partkey, (l_linenumber, l_partkey)) AS k2 FROM lineitem GROUP BY 1) e ON e.l_orderkey = o_orderkey LEFT JOIN part x ON x.p_partkey = k1 LEFT JOIN part y ON y.p_partkey = k2))""",
    "entry": f"entry AS MATERIALIZED (SELECT entity, type, label, more, CASE WHEN regexp_matches(entity, '^problem:.*1$') THEN 'DRAFT' ELSE 'APPROVED' END AS status, row_number() OVER (ORDER BY entity, label) AS entry_ord FROM ({_ENTRIES}))",
    "term": "term AS MATERIALIZED (SELECT entity, type, label AS alias, " + _MARKED.format(x="label") + " AS la, 0 AS alias_ord, entry_ord FROM entry WHERE status = 'APPROVED' UNION ALL SELECT entity, type, more, " + _MARKED.format(x="more") + ", 1, entry_ord FROM entry WHERE status = 'APPROVED' AND more <> '')",
    "sent": "sent AS MATERIALIZED (SELECT id, s, " + _MARKED.format(x="s") + " AS ls, pos FROM (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(replace(abstract, chr(10), ' '), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM ab)))",
    "hit": "hit AS MATERIALIZED (SELECT id, pos, s, entity, type, alias_ord FROM sent, term WHERE " + _HIT.format(t="ls") + ")",
    "said": "said AS MATERIALIZED (SELECT id, entity, type, alias_ord, arg_min(s, pos) AS ev, " + ", ".join(f"bool_or(regexp_matches(s, '(?i){v}')) AS c_{k}" for k, v in _CUES.items()) + " FROM hit GROUP BY 1, 2, 3, 4)",
    "headed": "headed AS MATERIALIZED (SELECT id, entity, type, alias_ord, title AS ev FROM (SELECT id, title, " + _MARKED.format(x="title") + " AS lt FROM ab), term WHERE " + _HIT.format(t="lt") + ")",
    "single": "single AS MATERIALIZED (SELECT t.entity FROM term t JOIN (SELECT lower(alias) AS a, count(DISTINCT entity) AS n FROM term GROUP BY 1) o ON lower(t.alias) = a WHERE alias_ord = 0 AND n <= 1)",
    "fired": "fired AS MATERIALIZED (" + " UNION ALL ".join([_fired(0, "'problem', 'concept'", "contribution", True), _fired(1, "'method'", "contribution", True), _fired(2, "'method', 'technique'", "use", False), _fired(3, "'benchmark'", "result", True), _fired(4, "'method'", "compare", False)]) + ")",
    "ruled": """ruled AS MATERIALIZED (SELECT id AS source, ['ADDRESSES', 'PROPOSES', 'USES', 'EVALUATES_ON', 'COMPARES_WITH'][r + 1] AS relation, entity AS target, ([0.75, 0.85, 0.70, 0.80, 0.65]::DOUBLE[])[r + 1] AS confidence, 'RULE_DERIVED' AS kind, CASE WHEN nt = 0 THEN 'title' ELSE 'abstract' END AS source_field,
      ['addresses.exact_alias.v1', 'proposes.title_or_abstract_pattern.v1', 'uses.alias_in_usage_sentence.v1', 'evaluates_on.exact_alias.v1', 'compares_with.alias_in_comparison_sentence.v1'][r + 1] AS rule_id, ev AS evidence, id AS source_paper, CAST(NULL AS VARCHAR) AS attribution, r AS rule_ord
      FROM (SELECT id, entity, r, arg_min(ev, (alias_ord, nt)) AS ev, arg_min(nt, (alias_ord, nt)) AS nt FROM fired GROUP BY 1, 2, 3) WHERE r <> 0 OR entity IN (SELECT entity FROM single))""",
    "limited": f"""limited AS MATERIALIZED (SELECT x.source, 'REPORTS_LIMITATION' AS relation, x.target, CAST(0.6 AS DOUBLE) AS confidence, 'RULE_DERIVED' AS kind, 'abstract' AS source_field, 'reports_limitation.method_and_limitation_in_sentence.v1' AS rule_id, ev AS evidence, x.id AS source_paper, CASE WHEN o.source IS NULL THEN 'THIRD_PARTY' ELSE 'SELF_REPORTED' END AS attribution, 5 AS rule_ord
      FROM (SELECT l.id, m.entity AS source, l.entity AS target, arg_min(l.s, l.pos) AS ev FROM hit l JOIN hit m ON l.id = m.id AND l.pos = m.pos WHERE l.type = 'limitation' AND l.alias_ord = 0 AND m.type = 'method' AND regexp_matches(l.s, '(?i){_CUES["limitation"]}') GROUP BY 1, 2, 3) x
      LEFT JOIN (SELECT source, target FROM ruled WHERE relation = 'PROPOSES') o ON o.source = x.id AND o.target = x.source)""",
    "prov": """prov AS MATERIALIZED (SELECT e.*, CASE WHEN e.rule_ord < 0 THEN 0 ELSE 1 END AS phase, a.paper_ord, CASE WHEN e.rule_ord < 0 THEN 0 ELSE coalesce(f.entry_ord, -1) END AS first_ord, CASE WHEN e.relation = 'REPORTS_LIMITATION' THEN g.entry_ord ELSE -1 END AS second_ord FROM (
      SELECT * FROM ruled UNION ALL SELECT * FROM limited UNION ALL SELECT a, 'CITES', b, CAST(0.95 AS DOUBLE), 'EXPLICIT_METADATA', 'references', NULL, b, a, NULL, -1 FROM cites) e
      JOIN ab a ON a.id = e.source_paper LEFT JOIN (SELECT entity, entry_ord FROM entry WHERE status = 'APPROVED') f ON f.entity = e.target LEFT JOIN (SELECT entity, entry_ord FROM entry WHERE status = 'APPROVED') g ON g.entity = e.source)""",
    "kedge": """kedge AS MATERIALIZED (SELECT printf('edge_%04d', row_number() OVER (ORDER BY phase, paper_ord, rule_ord, first_ord, second_ord, source, target)) AS edge_id, * EXCLUDE (phase, paper_ord, rule_ord, first_ord, second_ord) FROM (
      SELECT *, count(*) OVER (PARTITION BY source, relation, target) - 1 AS corroborating FROM prov QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY phase, paper_ord, rule_ord, first_ord, second_ord, source, target) = 1))""",
}

#: All that the table of knowledge edges needs.
KNOWLEDGE = "cites pb vocab ab entry term sent hit said headed single fired ruled limited prov kedge"



def with_(names: str, select: str) -> str:
    """A query over the named views."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + " " + select
