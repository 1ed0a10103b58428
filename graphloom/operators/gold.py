"""Checks of human-annotated gold sets.

Proposals: proposal_id, split, scope, raw_text, n_relevant (papers judged relevant). Facets: proposal_id, facet_id, facet_text, gold_label, is_combination, concepts (array).
Tensions: proposal_id, facet_id, status, supporting, challenging (arrays of papers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ontology import ENTITIES
from .validate import duplicates, issues, union

# Terms that may hint at a label, bounds of facets and words.
HINTS = ("well explored", "well-explored", "partially explored", "underrepresented", "under-represented", "underexplored", "under-explored", "unexplored", "no prior work", "novel")
LEAST_FACETS, MOST_FACETS, LEAST_WORDS = 3, 5, 6


def facet_text_checks(facets: DataFrame, least_words: int = LEAST_WORDS, hints: tuple[str, ...] = HINTS) -> DataFrame:
    """Facet texts (facet_id, facet_text) that are too short, show an id of the graph or a snake_case name; wordings that hint at a label are warnings."""
    t, at = F.col("facet_text"), F.col("facet_id")
    prefixes = "|".join(sorted(e[1] for e in ENTITIES))
    leak = rf"(?i)\b(?:{prefixes}):[a-z0-9][a-z0-9_.\-]*"
    hinted = facets.select("facet_id", F.explode(F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(t), h))).alias("h"))
    return union(
        issues(facets.where(T.word_count(t) < least_words), "GOLD_FACET_SHORT", at), issues(facets.where(F.rlike(t, F.lit(leak)) | F.rlike(t, F.lit(r"\b[a-z]+(?:_[a-z]+)+\b"))), "GOLD_ONTOLOGY_LEAK", at),
        issues(hinted, "GOLD_LABEL_HINT", F.concat_ws("|", "facet_id", "h"), "WARNING"),
    )


def gold_checks(proposals: DataFrame, facets: DataFrame, tensions: DataFrame, least: int = LEAST_FACETS, most: int = MOST_FACETS, least_words: int = LEAST_WORDS, hints: tuple[str, ...] = HINTS) -> DataFrame:
    """All structural checks: number and kind of facets, out-of-scope proposals, texts, concept ids, tensions."""
    per = facets.groupBy("proposal_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("is_combination"), F.lit(False)).alias("combined"), F.count_if(F.col("gold_label") != "UNKNOWN").alias("labelled"))
    rows = proposals.join(per, "proposal_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    concepts = facets.select("facet_id", F.explode("concepts").alias("c"))
    lost = tensions.join(facets.select("proposal_id", "facet_id"), ["proposal_id", "facet_id"], "left_anti")
    both = F.array_distinct(F.concat("supporting", "challenging"))
    at = F.col("proposal_id")
    return union(
        issues(rows.where((F.col("n") < least) | (F.col("n") > most)), "GOLD_FACET_COUNT", at), issues(rows.where("scope = 'IN_SCOPE' AND NOT coalesce(combined, false)"), "GOLD_NO_COMBINATION", at),
        issues(rows.where("scope = 'OUT_OF_SCOPE' AND coalesce(labelled, 0) > 0"), "GOLD_OOS_LABEL", at), issues(rows.where("scope = 'OUT_OF_SCOPE' AND n_relevant > 0"), "GOLD_OOS_RELEVANT", at),
        facet_text_checks(facets, least_words, hints), issues(concepts.where("NOT startswith(c, 'concept:')"), "GOLD_CONCEPT_ID", F.concat_ws("|", "facet_id", "c")), issues(lost, "GOLD_TENSION_FACET", F.concat_ws("|", "proposal_id", "facet_id")),
        issues(tensions.where((F.col("status") == "CONFLICTING") & ((F.size("supporting") < 1) | (F.size("challenging") < 1) | (F.size(both) < 2))), "GOLD_TENSION_CONFLICTING", F.concat_ws("|", "proposal_id", "facet_id")),
    )


def gold_schema_checks(proposals: DataFrame, facets: DataFrame, split: str) -> DataFrame:
    """Rows that belong to another split or proposal, malformed and repeated ids."""
    at = F.col("proposal_id")
    stray = facets.where(~F.col("facet_id").startswith(F.concat(F.col("proposal_id"), F.lit("."))))
    return union(
        duplicates(proposals, ["proposal_id"], "GOLD_DUP_PROPOSAL"), duplicates(facets, ["facet_id"], "GOLD_DUP_FACET"), issues(proposals.where((F.col("split") != split) | ~F.rlike("proposal_id", F.lit(f"^{split}-[0-9]{{3}}$"))), "GOLD_SPLIT", at),
        issues(facets.where(~F.rlike("facet_id", F.lit(r"^(dev|test)-[0-9]{3}\.f[1-9][0-9]*$"))), "GOLD_FACET_ID", F.col("facet_id")), issues(stray, "GOLD_FACET_STRAY", F.col("facet_id")),
    )
