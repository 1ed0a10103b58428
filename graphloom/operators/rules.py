"""Edges from text by a declarative table of alias and cue rules; matching, de-duplication, provenance and numbering.

Every rule gives evidence rows: one for each paper and entry at which it fires, with its provenance. ``edges_of`` makes one edge of all
evidence rows of a triple: the first row in build order is its provenance, the later ones corroborate it and stay rows of their own, so
that no triple gathers its provenance in one value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


@dataclass(frozen=True)
class Rule:
    """``cue``: name of the cue that a sentence must hold beside an alias; ``one_owner``: labels that several approved entries claim fire nothing."""

    rule_id: str
    relation: str
    types: tuple[str, ...]
    cue: str
    title_counts: bool
    confidence: float
    in_title: str
    in_abstract: str
    one_owner: bool = False


# Ids, confidences, kinds and decisions of the rules, in build order.
RULES = (
    Rule("addresses.exact_alias.v1", "ADDRESSES", ("problem", "concept"), "contribution", True, 0.75, "alias in title", "alias in contribution sentence", True),
    Rule("proposes.title_or_abstract_pattern.v1", "PROPOSES", ("method",), "contribution", True, 0.85, "method alias appears in title or proposal language", "method alias appears in title or proposal language"),
    Rule("uses.alias_in_usage_sentence.v1", "USES", ("method", "technique"), "use", False, 0.70, "", "method/technique alias appears beside usage language"),
    Rule("evaluates_on.exact_alias.v1", "EVALUATES_ON", ("benchmark",), "result", True, 0.80, "benchmark alias appears in title or evaluation language", "benchmark alias appears in title or evaluation language"),
    Rule("compares_with.alias_in_comparison_sentence.v1", "COMPARES_WITH", ("method",), "compare", False, 0.65, "", "method alias appears beside comparison language"),
)
LIMITATION_RULE = ("reports_limitation.method_and_limitation_in_sentence.v1", 0.60, "method and limitation aliases appear with limitation language")
CITES_CONFIDENCE = 0.95
#: Columns of an evidence row behind source, relation, target: provenance type, field, rule, decision, evidence, reporting paper, attribution.
PROVENANCE = ("kind", "source_field", "rule_id", "mapping_decision", "evidence", "source_paper", "attribution")

#: First words of aliases that are read to the driver at most; aliases that are sent to every task at most, beyond which they are joined by key.
FEW = 500
ALIASES = 100_000


def _marked(x: Column) -> Column:
    """Lower case with every run of word characters between marks: a term that begins and ends with such characters stands whole in a text where its marked form is a part of the text's."""
    return F.regexp_replace(F.lower(x), "([a-z0-9_]+)", "<$1>")


def term_matches(texts: DataFrame, aliases: DataFrame, text_col: str = "text") -> DataFrame:
    """texts (with columns kept) joined with aliases (entity, alias) on whole-term occurrence.

    The join is on the alias's first word, so it deals out by key instead of pairing every text with every alias; the exact test follows.
    Aliases without a word character are matched against all texts as a small side of their own. Up to FEW different first words
    are read at once, so that a text is only repeated for those it holds; with more, it is repeated for each of its words.
    Up to ALIASES aliases are sent to every task, as a word that many texts hold would gather these in one task.
    """
    keyed = aliases.withColumn("_k", F.regexp_extract(F.lower("alias"), r"([a-z0-9_]+)", 1))
    keyed = keyed.withColumn("_w", F.when(F.rlike(F.lower("alias"), F.lit("^[a-z0-9_](?s:.*[a-z0-9_])?$")), _marked(F.col("alias"))))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9_]+"), 0))
    rows = keyed.where("_k IS NOT NULL").groupBy("_k").agg(F.count("*").alias("n")).limit(FEW + 1).collect()
    first = [r["_k"] for r in rows]
    if len(first) <= FEW:
        found = F.filter(found, lambda w: w.isin(*first))
        few = sum(r["n"] for r in rows) <= ALIASES
    else:
        few = keyed.limit(ALIASES + 1).count() <= ALIASES
    if len(first) > FEW or "" in first:
        found = F.array_union(found, F.array(F.lit("")))
    words = texts.withColumns({"_t": _marked(F.col(text_col)), "_f": found}).withColumn("_k", F.explode("_f")).drop("_f")  # told once for each text
    whole = F.when(F.col("_w").isNotNull(), F.contains("_t", "_w")).otherwise(T.matches(F.col(text_col), F.col("alias")))
    return words.join(F.broadcast(keyed) if few else keyed, "_k").where(whole).drop("_k", "_t", "_w")


def sentence_rows(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select("*", F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence")).drop(text_col)


def single_owners(vocabulary: DataFrame) -> DataFrame:
    """entity of every entry whose label (its first alias) is an alias of no other entry."""
    low = vocabulary.select("entity", F.lower("alias").alias("a"))
    owners = low.groupBy("a").agg(F.count_distinct("entity").alias("n"))
    label = vocabulary.groupBy("entity").agg(F.lower(F.min_by("alias", F.struct("alias_ord", "alias"))).alias("a"))
    return label.join(owners, "a").where("n <= 1").select("entity")


def _small(rows: DataFrame) -> DataFrame:
    """rows of a vocabulary, sent to every task where they are at most ALIASES."""
    return F.broadcast(rows) if rows.limit(ALIASES + 1).count() <= ALIASES else rows


def rule_edges(papers: DataFrame, vocabulary: DataFrame, cues: dict[str, str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Evidence rows of every rule that fires; papers: id, title, abstract; vocabulary (approved entries): entity, type, alias, alias_ord; also rule_ord.

    A rule fires where an alias stands in the title (if titles count) or with the rule's cue in one sentence; the first alias of an
    entity wins, and the evidence is the title or the first sentence with that alias. Titles and sentences are matched once for all rules.
    """
    more = [c for c in ("paper_ord",) if c in papers.columns]
    texts = F.concat(F.array(F.struct(F.lit(True).alias("in_title"), F.lit(-1).alias("pos"), F.col("title").alias("text"))), F.coalesce(F.transform(T.sentences(F.col("abstract")), lambda s, n: F.struct(F.lit(False).alias("in_title"), n.alias("pos"), s.alias("text"))), F.array()))
    # Papers are dealt by their id once: all groups below are groups of papers, so their rows stay where they are.
    rows = papers.select("id", *more, "title", "abstract").repartition("id").select("id", *more, F.inline(texts))
    # What a rule needs of a text is told once for each text, ahead of its terms: the rules, as bits, whose cue it holds or whose title it is.
    bit = lambda r, k: F.when(F.col("in_title") if r.title_counts else F.lit(False), 1 << k).when(~F.col("in_title") & F.rlike("text", F.lit("(?i)" + cues[r.cue])), 1 << k).otherwise(0)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [bit(r, k) for k, r in enumerate(rules)])
    hits = term_matches(rows.withColumn("bits", bits), vocabulary.where(F.col("type").isin(*{t for r in rules for t in r.types})))
    said = hits.groupBy("id", *more, "entity", "type", "alias", "alias_ord", "in_title").agg(F.min_by("text", "pos").alias("evidence"), F.bit_or("bits").alias("bits"))
    fires = F.array(*[F.when(F.col("type").isin(*r.types) & (F.col("bits").bitwiseAND(1 << k) != 0), F.lit(k)) for k, r in enumerate(rules)])
    hits = said.select("id", *more, "entity", "alias_ord", "in_title", "evidence", F.explode(F.array_compact(fires)).alias("rule_ord"))
    first = hits.groupBy("id", *more, "entity", "rule_ord").agg(F.min_by(F.struct("in_title", "evidence"), F.struct("alias_ord", ~F.col("in_title"))).alias("w"))
    guarded = [k for k, r in enumerate(rules) if r.one_owner]
    if guarded:
        first = first.join(_small(single_owners(vocabulary).withColumn("_one", F.lit(True))), "entity", "left").where(~F.col("rule_ord").isin(*guarded) | F.col("_one").isNotNull())
    of = lambda f: F.get(F.array(*[F.lit(f(r)) for r in rules]), F.col("rule_ord"))
    return first.select(
        F.col("id").alias("source"), of(lambda r: r.relation).alias("relation"), F.col("entity").alias("target"), of(lambda r: r.confidence).alias("confidence"), F.lit("RULE_DERIVED").alias("kind"),
        F.when(F.col("w.in_title"), "title").otherwise("abstract").alias("source_field"), of(lambda r: r.rule_id).alias("rule_id"), F.when(F.col("w.in_title"), of(lambda r: r.in_title)).otherwise(of(lambda r: r.in_abstract)).alias("mapping_decision"),
        F.col("w.evidence").alias("evidence"), F.col("id").alias("source_paper"), F.lit(None).cast("string").alias("attribution"), "rule_ord", *more,
    )


def cooccurrences(sentence_hits_a: DataFrame, sentence_hits_b: DataFrame) -> DataFrame:
    """(id, a, b, pos): entities of two sets in one sentence, at their first common sentence."""
    a = sentence_hits_a.select("id", "pos", F.col("entity").alias("a")).distinct()
    b = sentence_hits_b.select("id", "pos", F.col("entity").alias("b")).distinct()
    return a.join(b, ["id", "pos"]).where("a <> b").groupBy("id", "a", "b").agg(F.min("pos").alias("pos"))


def limitation_edges(papers: DataFrame, vocabulary: DataFrame, cues: dict[str, str], proposals: DataFrame | None = None) -> DataFrame:
    """Evidence rows of methods that report a limitation, by paper (REPORTS_LIMITATION).

    Fires at the first sentence of the abstract with a limitation's label (its first alias), any alias of a method and the cue of limitations;
    SELF_REPORTED where the paper proposes that method, else THIRD_PARTY. papers and vocabulary as for ``rule_edges``; ``proposals``: its PROPOSES rows, if made already.
    """
    label = vocabulary.where("type = 'limitation'").groupBy("entity").agg(F.min_by("alias", F.struct("alias_ord", "alias")).alias("alias"))
    terms = vocabulary.where("type = 'method'").select("entity", "alias", F.lit(True).alias("method")).unionByName(label.select("entity", "alias", F.lit(False).alias("method")))
    more = [c for c in ("paper_ord",) if c in papers.columns]
    dealt = papers.select("id", *more, "title", "abstract").repartition("id").select("id", *more, F.col("abstract").alias("text"))  # as in rule_edges
    cued = sentence_rows(dealt).withColumnRenamed("sentence", "text").where(F.rlike("text", F.lit("(?i)" + cues["limitation"])))
    rows = term_matches(cued, terms)
    # A sentence's terms are few: both kinds are gathered for each sentence and paired there.
    at = rows.groupBy("id", *more, "pos", "text").agg(F.collect_set(F.when(F.col("method"), F.col("entity"))).alias("source"), F.collect_set(F.when(~F.col("method"), F.col("entity"))).alias("target"))
    both = at.where("size(source) > 0 AND size(target) > 0").withColumn("source", F.explode("source")).withColumn("target", F.explode("target"))
    first = both.groupBy("id", *more, "source", "target").agg(F.min_by("text", "pos").alias("evidence"))
    if proposals is None:
        # Only papers that such a sentence stands in are asked.
        told = papers.where(F.exists(T.sentences(F.col("abstract")), lambda s: F.rlike(s, F.lit("(?i)" + cues["limitation"]))))
        proposals = rule_edges(told, vocabulary, cues, tuple(r for r in RULES if r.relation == "PROPOSES"))
    own = proposals.groupBy(F.col("source").alias("id")).agg(F.collect_set("target").alias("own"))  # one paper's methods
    told = F.when(F.array_contains("own", F.col("source")), "SELF_REPORTED").otherwise("THIRD_PARTY")  # by whom
    rule, confidence, decision = LIMITATION_RULE
    return first.join(own, "id", "left").select(
        "source", F.lit("REPORTS_LIMITATION").alias("relation"), "target", F.lit(confidence).alias("confidence"), F.lit("RULE_DERIVED").alias("kind"), F.lit("abstract").alias("source_field"), F.lit(rule).alias("rule_id"),
        F.lit(decision).alias("mapping_decision"), "evidence", F.col("id").alias("source_paper"), told.alias("attribution"), F.lit(len(RULES)).alias("rule_ord"), *more,
    )


def citation_evidence(cites: DataFrame) -> DataFrame:
    """Evidence rows of citations (citing, target, ref_ord, evidence) that reference lists state."""
    none = F.lit(None).cast("string")
    return cites.select(
        F.col("citing").alias("source"), F.lit("CITES").alias("relation"), "target", F.lit(CITES_CONFIDENCE).alias("confidence"), F.lit("EXPLICIT_METADATA").alias("kind"), F.lit("references").alias("source_field"), none.alias("rule_id"),
        none.alias("mapping_decision"), "evidence", F.col("citing").alias("source_paper"), none.alias("attribution"), F.lit(-1).alias("rule_ord"), F.col("ref_ord").cast("long").alias("ref_ord"),
    )


def curated_evidence(curated: DataFrame) -> DataFrame:
    """Evidence rows of approved curated edges (ord, source, relation, target, passage, paper, attribution, status)."""
    none = F.lit(None).cast("string")
    return curated.where("status = 'APPROVED'").select(
        "source", "relation", "target", F.lit(1.0).alias("confidence"), F.lit("MANUALLY_CURATED").alias("kind"), F.lit("curation_file").alias("source_field"), none.alias("rule_id"), none.alias("mapping_decision"),
        F.col("passage").alias("evidence"), F.col("paper").alias("source_paper"), "attribution", F.lit(len(RULES) + 1).alias("rule_ord"), F.col("ord").cast("long").alias("ref_ord"),
    )


def build_evidence(papers: DataFrame, vocabulary: DataFrame, cues: dict[str, str], cites: DataFrame | None = None, curated: DataFrame | None = None, limits_only: bool = False) -> DataFrame:
    """All evidence rows of a knowledge build: citations, rules, limitations, curated edges. ``limits_only``: those of limitations (REPORTS_LIMITATION) alone, which need no others.

    papers: id, paper_ord, title, abstract; vocabulary (approved entries): entity, type, alias, alias_ord, entry_ord; cites: citing, target, ref_ord, evidence. Build order is
    (phase, paper_ord, rule_ord, first entry, second entry): all citations come first, curated edges last.
    """
    vocabulary = written(vocabulary, "vocabulary")
    papers = written(papers.select("id", "paper_ord", "title", "abstract"), "papers")
    if limits_only:
        parts = [limitation_edges(papers, vocabulary, cues)]
    else:
        ruled = written(rule_edges(papers, vocabulary, cues), "ruled")
        parts = [ruled, limitation_edges(papers, vocabulary, cues, ruled.where("relation = 'PROPOSES'"))]
    place = papers.select(F.col("id").alias("source_paper"), "paper_ord")
    made = len(parts)
    if cites is not None and not limits_only:
        parts.append(citation_evidence(cites).join(place, "source_paper", "left"))
    if curated is not None:
        rows = curated_evidence(curated)
        parts.append((rows.where("relation = 'REPORTS_LIMITATION'") if limits_only else rows).join(place, "source_paper", "left"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*(p.withColumn("ref_ord", F.lit(None).cast("long")) for p in parts[:made]), *parts[made:]])
    entry = _small(vocabulary.select("entity", "entry_ord").distinct())
    placed, limits = rows, F.col("relation") == "REPORTS_LIMITATION"
    for name, end in (("first", "target"), ("second", "source")):
        placed = placed.join(entry.select(F.col("entity").alias(end), F.col("entry_ord").alias(f"{name}_ord")), end, "left")
    phase = F.when(F.col("rule_ord") < 0, 0).when(F.col("rule_ord") > len(RULES), 2).otherwise(1)
    place = {"paper_ord": F.col("paper_ord"), "rule_ord": F.col("rule_ord"), "first_ord": F.coalesce("ref_ord", "first_ord"), "second_ord": F.when(limits, F.col("second_ord"))}
    return placed.select("source", "relation", "target", "confidence", *PROVENANCE, phase.alias("phase"), *[F.coalesce(c.cast("long"), F.lit(-1)).alias(n) for n, c in place.items()])


ORDER = ("phase", "paper_ord", "rule_ord", "first_ord", "second_ord", "source", "target")


def first_rows(evidence: DataFrame) -> DataFrame:
    """One edge for each triple, without a number: the columns of ``edges_of`` but edge_id, and ``o``, its place in build order."""
    first = F.min_by(F.struct("confidence", *PROVENANCE), F.struct(*ORDER))
    rows = evidence.groupBy("source", "relation", "target").agg(first.alias("p"), F.min(F.struct(*ORDER)).alias("o"), (F.count("*") - 1).alias("corroborating"))
    return rows.select("source", "relation", "target", "p.*", "corroborating", "o")


def edges_of(evidence: DataFrame, width: int = 4) -> DataFrame:
    """One edge for each triple, numbered by its first evidence row in build order: edge_id, source, relation, target, confidence, provenance of that row, corroborating (later rows)."""
    return number(first_rows(evidence), ["o"], width).select("edge_id", "source", "relation", "target", "confidence", *PROVENANCE, "corroborating")


def accumulate(edges: DataFrame) -> DataFrame:
    """One row per (source, relation, target): provenance of the least ``ord``, and how many later rows corroborate it."""
    rows = edges.groupBy("source", "relation", "target").agg(F.min("ord").alias("ord"), F.min_by("provenance", F.struct("ord", "provenance")).alias("provenance"), (F.count("*") - 1).alias("corroborating"))
    return rows


def number(edges: DataFrame, order: list[str], width: int = 4) -> DataFrame:
    """Edge ids by running number in ``order``, without a single task for all rows.

    Rows are dealt by ranges of the order; each row's number is its rank in its range and the rows of all ranges before.
    """
    ranged = edges.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # A running id holds the range and, in its last 33 bits, the row's rank in it: ranges are written in order, so nothing is dealt or sorted again.
    ranged = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranges").withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    base = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("base"))  # one row for each range
    return ranged.join(F.broadcast(base), "_p").withColumn("edge_id", F.format_string(f"edge_%0{width}d", F.col("base") + F.col("_r") + 1)).drop("_m", "_p", "_r", "base")
