"""Human-approved inputs: vocabulary entries, ambiguous terms and curated edges; what of them enters a build, and what is wrong with them.

Vocabulary: entity, type, label, aliases (array), status (DRAFT or APPROVED), approved_by, approved_on. Ambiguous terms: alias, candidates (array).
Curated edges: curation_id, source, relation, target, papers (array, of the evidence passages), attribution, status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .identity import metadata_status
from .validate import duplicates, issues, missing_candidates, undeclared_ambiguity, union


def approved(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'APPROVED'")


def alias_rows(vocabulary: DataFrame) -> DataFrame:
    """(entity, type, alias, alias_ord, entry_ord): the label first, then the aliases in their order; entries in order of ``entry_ord``."""
    all_ = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return vocabulary.select("entity", "type", F.posexplode(all_).alias("alias_ord", "alias"), "entry_ord").select("entity", "type", "alias", "alias_ord", "entry_ord")


def kept_ambiguities(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ambiguous terms all of whose candidates are approved entries."""
    good = approved(vocabulary).select(F.col("entity").alias("c")).distinct().withColumn("_ok", F.lit(True))
    lost = terms.select("alias", F.explode("candidates").alias("c")).join(good, "c", "left").where("_ok IS NULL").select("alias").distinct()
    return terms.join(lost, "alias", "left_anti")


def paper_entities(papers: DataFrame) -> DataFrame:
    """(id, type, label, attributes) of selected papers: canonical_id, title, abstract, year, authors, venue, doi."""
    attributes = F.create_map(
        F.lit("title"), F.col("title"), F.lit("year"), F.col("year").cast("string"), F.lit("venue"), F.col("venue"), F.lit("canonical_id"), F.col("canonical_id"), F.lit("identity_status"), F.lit("RESOLVED"),
        F.lit("metadata_status"), metadata_status(F.col("abstract"), F.col("year"), F.col("title"), F.col("authors")),
    )
    return papers.select(F.concat(F.lit("paper:"), T.slug(F.col("canonical_id"))).alias("id"), F.lit("paper").alias("type"), F.col("title").alias("label"), attributes.alias("attributes"))


def vocabulary_entities(vocabulary: DataFrame) -> DataFrame:
    attributes = F.create_map(F.lit("entity_source"), F.lit("APPROVED_VOCABULARY"), F.lit("approval_status"), F.col("status"))
    return approved(vocabulary).select(F.col("entity").alias("id"), "type", "label", attributes.alias("attributes"))


def vocabulary_checks(vocabulary: DataFrame, terms: DataFrame, types: DataFrame) -> DataFrame:
    """All checks of a vocabulary file; drafts are warnings."""
    at = F.col("entity")
    source = vocabulary.join(F.broadcast(types.select("type", "source")), "type", "left")
    prefix = vocabulary.join(F.broadcast(types.select(F.col("prefix").alias("p"), F.col("type").alias("of"))), F.split_part("entity", F.lit(":"), F.lit(1)) == F.col("p"), "left")
    names = vocabulary.select("entity", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return union(
        duplicates(vocabulary, ["entity"], "VOCAB_DUP_ID"), issues(source.where("NOT coalesce(source = 'APPROVED_VOCABULARY', false)"), "VOCAB_WRONG_SOURCE", at),
        issues(prefix.where(~F.col("of").eqNullSafe(F.col("type"))), "VOCAB_PREFIX_MISMATCH", at), issues(vocabulary.where("status = 'DRAFT'"), "VOCAB_DRAFT", at, "WARNING"),
        issues(vocabulary.where("status = 'APPROVED' AND (coalesce(approved_by, '') = '' OR coalesce(approved_on, '') = '')"), "VOCAB_APPROVAL", at),
        undeclared_ambiguity(names, terms), missing_candidates(terms, vocabulary.select(F.col("entity").alias("id")), "VOCAB_AMBIGUITY_CANDIDATE"),
    )


def curation_checks(curated: DataFrame, spec: DataFrame, types: DataFrame) -> DataFrame:
    """All checks of curated edges. A relation that is not stored ends an edge's checks, and so does an end without a known prefix; drafts are warnings."""
    at = F.col("curation_id")
    rows = curated.join(F.broadcast(spec.withColumnRenamed("status", "relation_status")), "relation", "left")
    for end, name in (("source", "st"), ("target", "tt")):
        rows = rows.join(F.broadcast(types.select(F.col("prefix").alias(f"p_{name}"), F.col("type").alias(name))), T.entity_type(F.col(end)) == F.col(f"p_{name}"), "left")
    # The first row of a repeated id is sound as far as the id goes.
    again = curated.withColumn("n", F.row_number().over(Window.partitionBy("curation_id").orderBy("source", "relation", "target"))).where("n > 1")
    active = rows.where("relation_status = 'ACTIVE'")
    known = active.where("st IS NOT NULL AND tt IS NOT NULL")
    papers = F.coalesce("papers", F.array().cast("array<string>"))
    mirrored = known.where("mirror_of IS NOT NULL").join(curated.select(F.col("source").alias("ms"), F.col("relation").alias("mr"), F.col("target").alias("mt")), F.expr("mirror_of = mr AND source = mt AND target = ms"), "left_semi")
    return union(
        issues(again, "CUR_DUP_ID", at), issues(rows.where("coalesce(relation_status, '') <> 'ACTIVE'"), "CUR_RELATION_NOT_STORABLE", at), issues(active.where("NOT array_contains(allowed, 'MANUALLY_CURATED')"), "CUR_NOT_CURATABLE", at),
        issues(active.where("source = target"), "CUR_SELF_LOOP", at), issues(active.where("st IS NULL OR tt IS NULL"), "CUR_UNKNOWN_PREFIX", at), issues(known.where("NOT array_contains(domain, st)"), "CUR_DOMAIN", at),
        issues(known.where("NOT array_contains(range, tt)"), "CUR_RANGE", at), issues(known.where("symmetric AND source > target"), "CUR_SYMMETRIC_ORDER", at), issues(mirrored, "CUR_MIRROR_CONFLICT", at),
        issues(known.where(F.col("needs_source") & ~F.exists(papers, lambda p: F.coalesce(p != "", F.lit(False)))), "CUR_SOURCE_PAPER_REQUIRED", at), issues(known.where("needs_attribution AND attribution IS NULL"), "CUR_ATTRIBUTION_REQUIRED", at),
        issues(known.where("attribution IS NOT NULL AND NOT needs_attribution"), "CUR_ATTRIBUTION_FORBIDDEN", at), issues(known.where((F.col("st") == "paper") & ~F.exists(papers, lambda p: F.coalesce(p == F.col("source"), F.lit(False)))), "CUR_EVIDENCE_REQUIRED", at),
        issues(known.where("status = 'DRAFT'"), "CUR_DRAFT", at, "WARNING"),
    )
