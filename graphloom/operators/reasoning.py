"""Query-time analysis of many proposals in one plan: grounding, retrieval, score, ranking, positioning, evidence, tensions, warnings.

``Analysis`` makes the shared parts (grounding, candidates, ranking) once, each as a written table, so that a request's outputs do not
plan them again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .graph import degrees
from .rules import PROVENANCE, term_matches

# Types that ground a proposal, weights of the prior-work score in the order of their addition, messages of the output.
GROUNDABLE = ("concept", "method", "problem", "benchmark", "technique")
WEIGHTS = {"concept": 0.30, "method": 0.20, "problem": 0.15, "benchmark": 0.10, "proximity": 0.10, "citation": 0.10, "temporal": 0.05}
INSUFFICIENT = "Insufficient evidence in the indexed corpus."
NOTHING_KNOWN = "No controlled vocabulary term matched; cannot ground the proposal."
AMBIGUOUS_TERMS = "Ambiguous matched terms: "

#: Matched entities that are sent to every task at most; beyond, they are joined by key.
MATCHED = 100_000


def ground(proposals: DataFrame, aliases: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(request_id, entity, type, alias, status); one alias for each entity, the least alias_ord.

    AMBIGUOUS where that alias has several owners and is declared ambiguous (declared: alias; without the table, every alias with
    several owners is), else MATCHED.
    """
    owners = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.count_distinct("entity").alias("owners"))
    if declared is not None:
        said = declared.select(T.squeeze(F.col("alias")).alias("_a"), F.lit(True).alias("_d")).distinct()
        owners = owners.join(said, "_a", "left").select("_a", F.when(F.col("_d"), F.col("owners")).otherwise(1).alias("owners"))
    usable = aliases.where(F.col("type").isin(*GROUNDABLE)).join(owners, F.lower("alias") == F.col("_a")).drop("_a")
    hits = term_matches(proposals.withColumn("text", T.squeeze(F.col("text"))), usable)
    first = hits.groupBy("request_id", "entity", "type").agg(F.min_by(F.struct("alias", "owners"), F.struct("alias_ord", "alias")).alias("m"))
    return first.select("request_id", "entity", "type", "m.alias", F.when(F.col("m.owners") > 1, "AMBIGUOUS").otherwise("MATCHED").alias("status"))


def unknown_terms(proposals: DataFrame, grounded: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request_id, unknown): up to five words of the proposal that belong to no alias of a matched entity, nor of an owner of an ambiguous alias."""
    low = aliases.select("entity", F.lower("alias").alias("a"))
    matched = grounded.where("status = 'MATCHED'").select("request_id", "entity")
    doubtful = grounded.where("status = 'AMBIGUOUS'").select("request_id", F.lower("alias").alias("a")).distinct().join(low, "a").select("request_id", "entity")
    pieces = matched.union(doubtful).distinct().join(low, "entity").select("request_id", F.explode(F.split("a", " ")).alias("w"))
    known = pieces.groupBy("request_id").agg(F.collect_set("w").alias("pieces"))  # words of the vocabulary
    some = matched.select("request_id").distinct().withColumn("_m", F.lit(True))
    rows = proposals.select("request_id", "text").join(known, "request_id", "left").join(some, "request_id", "left")
    return rows.select("request_id", T.unknown_terms(F.coalesce("text", F.lit("")), F.col("pieces"), F.col("_m").isNull()).alias("unknown"))


def incident(edges: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(paper, entity, more) of every edge that has a paper at one end, from one scan; an edge of two papers comes twice."""
    ends = F.array(F.struct(F.col("source").alias("paper"), F.col("target").alias("entity")), F.struct(F.col("target").alias("paper"), F.col("source").alias("entity")))
    return edges.select(F.inline(F.filter(ends, lambda e: e["paper"].startswith("paper:"))), *more)


def _matched_only(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """rows (entity) of matched entities: by a broadcast of their ids where these are at most MATCHED, else by key."""
    ids = matched.select("entity").distinct()
    small = ids.limit(MATCHED + 1).count() <= MATCHED
    return rows.join(F.broadcast(ids) if small else ids, "entity", "left_semi")


def candidates(grounded: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, paper, entity, type, n_edges): papers with an edge to or from a matched entity, and how many."""
    matched = grounded.where("status = 'MATCHED'").select("request_id", "entity", "type")
    # Edges are cut down to matched entities before anything is shuffled, and counted before requests multiply them.
    counted = _matched_only(incident(edges), matched).groupBy("paper", "entity").agg(F.count("*").alias("n_edges"))
    return counted.join(matched, "entity").select("request_id", "paper", "entity", "type", "n_edges")


def share(hit: Column, of: Column) -> Column:
    return F.when(F.coalesce(of, F.lit(0)) > 0, hit / of).otherwise(F.lit(0.0))


def scored(grounded: DataFrame, found: DataFrame, papers: DataFrame, cites: DataFrame, now: int, features: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(request_id, paper, score, n_matched, n_evidence, features) of every candidate; papers: id, year; cites: a, b.

    The terms of the score keep one order, as thresholds are met exactly; ``features`` that are left out add nothing (an ablation).
    Candidates are at one step from a matched entity by construction, so their proximity is 1.
    """
    kinds = ("concept", "method", "problem", "benchmark")
    wanted = grounded.where("status = 'MATCHED'").groupBy("request_id").agg(*[F.count_if(F.col("type") == t).alias(f"u_{t}") for t in kinds])
    hits = found.groupBy("request_id", "paper").agg(*[F.count_if(F.col("type") == t).alias(f"h_{t}") for t in kinds], F.count("*").alias("n_matched"), F.sum("n_edges").alias("n_evidence"))
    degree = degrees(cites)
    top = degree.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("top_degree"))  # one row
    rows = hits.join(wanted, "request_id").join(degree, F.col("paper") == F.col("id"), "left").drop("id").join(papers.select("id", "year"), F.col("paper") == F.col("id"), "left").join(F.broadcast(top))
    part = {t: share(F.col(f"h_{t}"), F.col(f"u_{t}")) for t in kinds} | {"proximity": F.lit(1.0), "citation": F.coalesce("degree", F.lit(0)) / F.col("top_degree"), "temporal": T.temporal(F.col("year"), now)}
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in features:
            score = score + F.lit(weight) * part[name]
    return rows.select("request_id", "paper", score.alias("score"), "n_matched", "n_evidence", F.struct(*[part[n].alias(n) for n in WEIGHTS]).alias("features"))


def ranked(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first k papers of each request by score and id, with rank and confidence."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "paper"))
    sure = F.when((F.col("score") >= 0.65) & (F.col("n_evidence") >= 2), "HIGH").when(F.col("score") >= 0.4, "MEDIUM").otherwise("LOW")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("request_id", "rank", "paper", "score", "n_matched", "n_evidence", sure.alias("confidence"))


def positioning(requests: DataFrame, grounded: DataFrame, found: DataFrame, top: DataFrame) -> DataFrame:
    """Label, sufficiency and confidence score of every request; those without matches or candidates stay with UNKNOWN."""
    m = grounded.where("status = 'MATCHED'").groupBy("request_id").agg(F.count("*").alias("n_match"))
    cover = found.groupBy("request_id", "paper").agg(F.count("*").alias("n")).groupBy("request_id").agg(F.count("*").alias("n_cand"), F.max("n").alias("best"))
    first = top.where("rank = 1").select("request_id", F.col("score").alias("top"))
    rows = requests.select("request_id").join(m, "request_id", "left").join(cover, "request_id", "left").join(first, "request_id", "left")
    n, coverage = F.coalesce("n_cand", F.lit(0)), F.coalesce(F.col("best") / F.col("n_match"), F.lit(0.0))
    none = F.coalesce("n_match", F.lit(0)) == 0
    label = F.when(none | (n == 0), "UNKNOWN").when((F.col("top") >= 0.65) & (coverage >= 0.6), "WELL_EXPLORED").when((coverage < 1) & (n <= 2), "UNDERREPRESENTED").when(F.col("top") >= 0.40, "PARTIALLY_EXPLORED").otherwise("UNKNOWN")
    enough = (
        F.when(none | (n == 0), "INSUFFICIENT").when((F.col("top") >= 0.65) & (coverage >= 0.6), F.when(n >= 2, "HIGH").otherwise("MEDIUM"))
        .when((coverage < 1) & (n <= 2), F.when(n == 1, "LOW").otherwise("MEDIUM")).when(F.col("top") >= 0.40, "MEDIUM").otherwise("LOW")
    )
    return rows.select("request_id", label.alias("label"), enough.alias("sufficiency"), (enough == "INSUFFICIENT").alias("abstain"), n.cast("long").alias("n_candidates"), F.coalesce("top", F.lit(0.0)).alias("confidence_score"))


def evidence(top: DataFrame, grounded: DataFrame, edges: DataFrame, papers: int = 5, each: int = 3, most: int = 10) -> DataFrame:
    """At most ``each`` edges for each of the first papers and ``most`` for a request.

    With numbered edges (edge_id and provenance columns) items follow the edges' order and carry basis, edge id, field, rule and fragment;
    else they follow entity and relation.
    """
    full = "edge_id" in edges.columns
    more = ("relation", *(("edge_id", *PROVENANCE) if full else ()))
    pick = top.where(F.col("rank") <= papers).select("request_id", "paper", "rank")
    matched = grounded.where("status = 'MATCHED'").select("request_id", "entity")
    rows = _matched_only(incident(edges, more), matched).join(pick, "paper").join(matched, ["request_id", "entity"])
    order = ["edge_id", "entity"] if full else ["entity", "relation"]
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy("request_id", "paper").orderBy(*order))).where(F.col("r") <= each)
    items = one.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "r"))).where(F.col("n") <= most)
    shown = ["request_id", "n", "paper", "entity", "relation"]
    if not full:
        return items.select(*shown)
    basis = F.when(F.col("kind") == "RULE_DERIVED", "RULE_DERIVED").otherwise("DIRECTLY_SUPPORTED")
    return items.select(*shown, basis.alias("basis"), "edge_id", "source_field", "rule_id", F.col("evidence").alias("fragment"))


def reading_path(top: DataFrame, found: DataFrame, k: int = 7) -> DataFrame:
    """The first k papers with a reason, the entries that a reader learns, and the relation to the proposal."""
    learned = ("concept", "problem", "method", "technique")
    shared = found.groupBy("request_id", "paper").agg(F.array_sort(F.collect_set("entity")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("type").isin(*learned), F.col("entity")))).alias("learned"))
    rows = top.where(F.col("rank") <= k).join(shared, ["request_id", "paper"])
    reason = F.format_string("shares %d grounded vocabulary entries with proposal", F.size("all"))
    why = F.concat(F.lit("Useful because it has typed edges to "), F.array_join("all", ", "))
    return rows.select("request_id", "rank", "paper", reason.alias("reason"), F.array_join("learned", ", ").alias("concepts_learned"), why.alias("relationship_to_proposal"))


def tensions(claims: DataFrame) -> DataFrame:
    """claims (claim, paper, side SUPPORTS or CHALLENGES): CONFLICTING where both sides and two papers at least stand, else INSUFFICIENT_EVIDENCE.

    Without any claim there is one row with a null claim.
    """
    sided = claims.where("side IN ('SUPPORTS', 'CHALLENGES')")
    per = sided.groupBy("claim").agg(F.count_if(F.col("side") == "SUPPORTS").alias("n_support"), F.count_if(F.col("side") == "CHALLENGES").alias("n_challenge"), F.count_distinct("paper").alias("n_papers"))
    none = sided.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(None).cast(claims.schema["claim"].dataType).alias("claim"), *[F.lit(0).cast("long").alias(c) for c in ("n_support", "n_challenge", "n_papers")])
    both = (F.col("n_support") > 0) & (F.col("n_challenge") > 0) & (F.col("n_papers") >= 2)
    return per.unionByName(none).withColumn("status", F.when(both, "CONFLICTING").otherwise("INSUFFICIENT_EVIDENCE"))


def claim_sides(edges: DataFrame) -> DataFrame:
    """(claim, paper, side) of SUPPORTS and CHALLENGES edges (relation, target, source_paper) whose target is a claim."""
    return edges.where(F.col("relation").isin("SUPPORTS", "CHALLENGES") & F.col("target").startswith("claim:")).select(F.col("target").alias("claim"), F.col("source_paper").alias("paper"), F.col("relation").alias("side"))


def limitations(edges: DataFrame) -> DataFrame:
    """Attributed assertions that a paper reports a method's limitation, from edges with provenance."""
    rows = edges.where("relation = 'REPORTS_LIMITATION'")
    return rows.select(F.col("source").alias("method"), F.col("target").alias("limitation"), F.coalesce("source_paper", F.lit("")).alias("reported_by"), F.coalesce("attribution", F.lit("")).alias("attribution"), "source_field", "rule_id", F.col("evidence").alias("fragment"))


def warnings(positions: DataFrame, grounded: DataFrame) -> DataFrame:
    """(request_id, warnings): messages on missing evidence, on no matched term and on ambiguous terms, in this order."""
    seen = grounded.groupBy("request_id").agg(F.count_if(F.col("status") == "MATCHED").alias("n_match"), F.array_sort(F.collect_set(F.when(F.col("status") == "AMBIGUOUS", F.lower("alias")))).alias("doubt"))
    rows = positions.join(seen, "request_id", "left")
    said = F.array(F.when(F.col("abstain"), F.lit(INSUFFICIENT)), F.when(F.coalesce("n_match", F.lit(0)) == 0, F.lit(NOTHING_KNOWN)), F.when(F.size("doubt") > 0, F.concat(F.lit(AMBIGUOUS_TERMS), F.array_join("doubt", ", "))))
    return rows.select("request_id", F.array_join(F.filter(said, lambda x: x.isNotNull()), " | ").alias("warnings"))


def output_checks(positions: DataFrame, path: DataFrame, warned: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Violations of what an output promises (code, location): one position a request, ranks 1..n without repeats, the message of missing
    evidence, no claim of novelty in texts of the system, and both sides and two papers behind a conflict."""
    say = lambda df, code, at: df.select(F.lit(code).alias("code"), F.col(at).cast("string").alias("location"))
    ranks = path.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("papers"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"))
    parts = [
        say(positions.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1"), "OUT_POSITION_REPEATED", "request_id"),
        say(warned.join(positions, "request_id", "left_anti"), "OUT_POSITION_MISSING", "request_id"),
        say(ranks.where("ranks <> n OR last <> n"), "OUT_RANKS", "request_id"), say(ranks.where("papers <> n"), "OUT_PAPER_REPEATED", "request_id"),
        say(positions.where("sufficiency = 'INSUFFICIENT'").join(warned, "request_id", "left").where(~F.coalesce(F.contains("warnings", F.lit(INSUFFICIENT)), F.lit(False))), "OUT_MESSAGE_MISSING", "request_id"),
        say(warned.where(T.claims_novelty(F.col("warnings"))), "OUT_NOVELTY", "request_id"), say(path.where(T.claims_novelty(F.col("reason"))), "OUT_NOVELTY", "request_id"),
        say(conflicts.where("status = 'CONFLICTING' AND (n_support = 0 OR n_challenge = 0 OR n_papers < 2)"), "OUT_CONFLICT", "claim"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Analysis:
    """The analysis of one batch of proposals (request_id, text) over one state; shared parts are made once."""

    def __init__(self, proposals: DataFrame, vocabulary: DataFrame, edges: DataFrame, papers: DataFrame, cites: DataFrame, now: int, declared: DataFrame | None = None):
        self.proposals, self.vocabulary, self.edges, self.papers, self.cites, self.now, self.declared = proposals, vocabulary, edges, papers, cites, now, declared

    @cached_property
    def grounded(self) -> DataFrame:
        return written(ground(self.proposals, self.vocabulary, self.declared), "grounded")

    @cached_property
    def candidates(self) -> DataFrame:
        return written(candidates(self.grounded, self.edges), "candidates")

    @cached_property
    def ranked(self) -> DataFrame:
        return written(ranked(scored(self.grounded, self.candidates, self.papers, self.cites, self.now)), "ranked")

    @cached_property
    def positions(self) -> DataFrame:
        return positioning(self.proposals, self.grounded, self.candidates, self.ranked)

    @property
    def evidence(self) -> DataFrame:
        return evidence(self.ranked, self.grounded, self.edges)

    @property
    def reading_path(self) -> DataFrame:
        return reading_path(self.ranked, self.candidates)

    @property
    def warnings(self) -> DataFrame:
        return warnings(self.positions, self.grounded)

    @property
    def unknown(self) -> DataFrame:
        return unknown_terms(self.proposals, self.grounded, self.vocabulary)

    def output(self) -> DataFrame:
        """One row a request: its grounding, prior work, reading path, position and warnings as one struct; ``to_json`` makes the output file."""
        of = lambda df, *cols: df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))  # noqa: E731  each is capped, or bounded by the vocabulary
        work = of(self.ranked, "rank", "paper", "score", "confidence").withColumnRenamed("x", "prior_work")
        path = of(self.reading_path, "rank", "paper", "reason", "concepts_learned", "relationship_to_proposal").withColumnRenamed("x", "reading_path")
        items = of(self.evidence, "n", *[c for c in self.evidence.columns if c not in ("request_id", "n")]).withColumnRenamed("x", "evidence")
        known = of(self.grounded.where("status = 'MATCHED'"), "entity").withColumnRenamed("x", "matched")
        rows = self.positions.join(self.warnings, "request_id").join(self.unknown, "request_id")
        for part in (known, work, path, items):
            rows = rows.join(part, "request_id", "left")
        return rows.select("request_id", F.struct("matched", "unknown", "prior_work", "reading_path", "evidence", F.struct("label", "sufficiency", "abstain", "confidence_score").alias("position"), "warnings").alias("output"))
