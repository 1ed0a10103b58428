"""Entity resolution of source records: exact keys, components, fallback keys with ambiguity, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .graph import components


def exact_groups(records: DataFrame, keys: Column) -> DataFrame:
    """records with grp: least rec_ord among records that share any key, transitively. ``keys``: array of strings.

    Records link to the least record of each key, so a key of m records makes m - 1 edges.
    """
    pairs = records.select("rec_ord", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
    least = pairs.groupBy("key").agg(F.min("rec_ord").alias("a"))
    comp = components(pairs.join(least, "key").select("a", F.col("rec_ord").alias("b")))
    return records.join(comp, records["rec_ord"] == comp["id"], "left").withColumn("grp", F.coalesce("component_id", "rec_ord")).drop("id", "component_id")


def fallback_groups(grouped: DataFrame, id_columns: list[str]) -> DataFrame:
    """Exact groups under one fallback key (that of each group's first record): (fbk, n_groups, n_records, ambiguous).

    Ambiguous: some kind of id has more than one value in the whole; then nothing merges.
    """
    first = grouped.groupBy("grp").agg(F.min_by("fbk", "rec_ord").alias("fbk"))
    members = grouped.drop("fbk").join(first, "grp")
    wide = F.lit(False)
    counts = [F.count_distinct(c).alias(f"d_{c}") for c in id_columns]
    for c in id_columns:
        wide = wide | (F.col(f"d_{c}") > 1)
    found = members.groupBy("fbk").agg(F.count_distinct("grp").alias("n_groups"), F.count("*").alias("n_records"), F.min("grp").alias("first_grp"), *counts)
    return found.select("fbk", "n_groups", "n_records", "first_grp", ((F.col("n_groups") > 1) & wide).alias("ambiguous"))


def resolve(grouped: DataFrame, id_columns: list[str]) -> DataFrame:
    """grouped with cand: its fallback group's first group where that is not ambiguous, else its own."""
    first = grouped.groupBy("grp").agg(F.min_by("fbk", "rec_ord").alias("fbk"))
    fall = fallback_groups(grouped, id_columns).select("fbk", "first_grp", "ambiguous")
    where = first.join(fall, "fbk").select("grp", F.when(F.col("ambiguous"), F.col("grp")).otherwise(F.col("first_grp")).alias("cand"), "ambiguous", F.col("fbk").alias("group_fbk"))
    return grouped.join(where, "grp")


def completeness(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int"), F.lit(0))
    return total


def roll_up(resolved: DataFrame, by: str, complete: Column, first_nonempty: list[str], maxima: list[str], sets: list[str], best_nonempty: list[str] = ()) -> DataFrame:
    """One row per candidate: title from the most complete record (then by source and order), ``best_nonempty`` likewise from the first record where they are not empty
    (authors), other scalars the first in record order that is not empty, maxima, sorted distinct sets."""
    rows = resolved.withColumn("_c", complete)
    said = lambda c: F.col(c).isNotNull() & (F.size(c) > 0 if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") != "")
    best = F.struct(-F.col("_c"), F.col("source"), F.col("rec_ord"))
    first = [F.min_by(c, F.when(said(c), F.col("rec_ord"))).alias(c) for c in first_nonempty] + [F.min_by(c, F.when(said(c), best)).alias(c) for c in best_nonempty]
    return rows.groupBy(by).agg(
        F.count("*").alias("n_records"), F.min_by("title", best).alias("title"), *first,
        *[F.max(c).alias(f"max_{c}") for c in maxima], *[F.array_sort(F.collect_set(c)).alias(f"all_{c}") for c in sets],
    )


def references_of(resolved: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, ref_ord, keys): the distinct references of each candidate in order of first occurrence; resolved: rec_ord and ``references``, an array of structs with the keys."""
    each = resolved.select(by, "rec_ord", F.posexplode("references").alias("pos", "r")).select(by, "rec_ord", "pos", *[F.col(f"r.{k}").alias(k) for k in keys])
    once = each.groupBy(by, *keys).agg(F.min(F.struct("rec_ord", "pos")).alias("o"))
    return once.withColumn("ref_ord", F.row_number().over(Window.partitionBy(by).orderBy("o", *keys))).select(by, "ref_ord", *keys)


def metadata_status(abstract: Column, year: Column, title: Column, authors: Column) -> Column:
    """COMPLETE where all four say something (a year of 0 does not), else PARTIAL_METADATA."""
    said = lambda c: F.coalesce(c != "", F.lit(False))
    whole = said(abstract) & F.coalesce(year != 0, F.lit(False)) & said(title) & F.coalesce(F.size(authors) > 0, F.lit(False))
    return F.when(whole, "COMPLETE").otherwise("PARTIAL_METADATA")


def canonical_id(doi: Column, arxiv: Column, s2: Column, fallback: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("s2:"), s2), fallback)


def prioritised_lookup(references: DataFrame, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """Citation edges: each reference's first key, in order, that the dictionary (key, target) knows; the last target of a key holds; no self-citation.

    references: citing, ref_ord and the key columns.
    """
    last = dictionary.groupBy("key").agg(F.max("target").alias("target"))
    tried = references.select("citing", "ref_ord", F.posexplode(F.array(*[F.col(k) for k in keys])).alias("prio", "key")).where("key IS NOT NULL")
    hit = tried.join(last, "key").groupBy("citing", "ref_ord").agg(F.min_by("target", "prio").alias("target"))
    return hit.where("citing <> target").select("citing", "target").distinct()


#: Weights of the candidate score: seed queries, log of citations, log of references, links in the pool, recency.
SCORE = {"seed_hits": 10.0, "citation_count": 1.0, "reference_count": 0.5, "in_pool_citation_degree": 2.0, "recency": 1.0}


def score_parts(papers: DataFrame, now: int) -> DataFrame:
    """papers (n_seeds, citation_count, reference_count, degree, year, and other columns kept) with ``parts``, a struct of the named parts, and their sum ``score``."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    of = {
        "seed_hits": zero("n_seeds"), "citation_count": F.log1p(zero("citation_count")), "reference_count": F.log1p(zero("reference_count")),
        "in_pool_citation_degree": zero("degree"), "recency": (zero("year") >= now).cast("int"),
    }
    parts = papers.withColumn("parts", F.struct(*[(F.lit(w) * of[n]).alias(n) for n, w in SCORE.items()]))
    total = F.lit(0.0)
    for n in SCORE:
        total = total + F.col(f"parts.{n}")
    return parts.withColumn("score", total)


#: Parts of a bucket that are ranked by themselves before the bucket is.
PARTS = 64


def quota_selection(scored: DataFrame, quotas: DataFrame, target: int) -> DataFrame:
    """Rows (id, bucket, score) chosen by bucket minima, then greedily up to maxima, then beyond them, until ``target``, in order of id.

    Class 0: within the bucket's minimum; 1: within its maximum or without one; 2: the rest. All of class 0 stay, and of
    the others, by (class, -score, id), as many as are missing. quotas: bucket, lo, hi; a small table.

    No choice reaches beyond the first lo + hi + target rows of a bucket. So parts of each bucket, dealt by a hash of the id, are ranked
    first and keep so many rows each; a task never ranks a whole bucket.
    """
    order = [F.desc("score"), F.asc("id")]
    sized = scored.select("id", "bucket", "score").join(F.broadcast(quotas), "bucket", "left")
    reach = F.coalesce("lo", F.lit(0)) + F.coalesce("hi", F.lit(0)) + target
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(PARTS))
    some = sized.withColumn("_r", F.row_number().over(Window.partitionBy("bucket", part).orderBy(*order))).where(F.col("_r") <= reach).drop("_r")
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    classed = ranked.withColumn("class", F.when(F.col("rn") <= F.coalesce("lo", F.lit(0)), 0).when(F.col("hi").isNull() | (F.col("rn") <= F.col("hi")), 1).otherwise(2))
    classed = written(classed.select("id", "bucket", "score", "class"), "classed")
    must = classed.where("class = 0")
    missing = max(0, target - must.count())
    # A global order and limit is a top-k: each task keeps at most ``missing`` rows.
    rest = classed.where("class > 0").orderBy("class", *order).limit(missing)
    return must.unionByName(rest).orderBy("id")
