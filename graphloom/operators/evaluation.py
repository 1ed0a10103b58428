"""Metrics of classification, ranking and abstention, retrieval baselines and resampling."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import reasoning as R


def macro_f1(judged: DataFrame) -> DataFrame:
    """Per class f1 from (gold, predicted, weight long); classes without gold rows are dropped by the caller's filter support > 0."""
    cells = judged.groupBy("gold", "predicted").agg(F.sum("weight").alias("w"))
    gold = cells.groupBy(F.col("gold").alias("class")).agg(F.sum("w").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("w")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("w").alias("said"))
    rows = gold.join(said, "class", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return rows.select("class", "support", "tp", "said", (F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("said"))).alias("f1"))


def ndcg(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per request (request_id, ndcg): gain 2^relevance - 1, discount log2(rank + 1); ranked: request_id, item, rank; gold: request_id, item, relevance."""
    gain = lambda r: (F.pow(F.lit(2.0), F.coalesce(r, F.lit(0))) - 1)
    got = ranked.where(F.col("rank") <= k).join(gold, ["request_id", "item"], "left").withColumn("x", gain(F.col("relevance")) / F.log2(F.col("rank") + 1))
    ideal = gold.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("relevance"), "item"))).where(F.col("rank") <= k).withColumn("x", gain(F.col("relevance")) / F.log2(F.col("rank") + 1))
    # Terms are added in the order of rank, so that the sum is one value on every run.
    total = lambda d, name: d.groupBy("request_id").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda s: s["x"]), F.lit(0.0), lambda a, b: a + b).alias(name))
    return total(ideal, "best").join(total(got, "dcg"), "request_id", "left").where("best > 0").select("request_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("best")).alias("ndcg"))


def precision_recall_mrr(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    good = gold.where("relevance > 0")
    hits = ranked.join(good.select("request_id", "item"), ["request_id", "item"]).groupBy("request_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    total = good.groupBy("request_id").agg(F.count("*").alias("n"))
    rows = total.join(hits, "request_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return rows.select("request_id", (h / F.lit(float(k))).alias("p_at_k"), (h / F.col("n").cast("double")).alias("r_at_k"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def risk_coverage(judged: DataFrame) -> DataFrame:
    """(rank, covered, errors, risk) by descending confidence, ties by id; judged: id, confidence, wrong (0 or 1).

    A running count over all rows needs one order; the rows are summed by confidence first, so the ordered window sees as many rows
    as there are distinct confidences.
    """
    per = judged.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    order = Window.orderBy(F.desc("confidence"))
    rows = per.select("confidence", F.sum("n").over(order).alias("covered"), F.sum("w").over(order).alias("errors"))
    return rows.withColumn("risk", F.col("errors") / F.col("covered"))


def _running(judged: DataFrame) -> DataFrame:
    """judged with k (rank by descending confidence, ties by id) and errors (wrong ones up to it), without one task for all rows.

    Rows are dealt by ranges of the order; each range's counts are added to those of the ranges before it.
    """
    keyed = judged.select("id", (-F.col("confidence")).alias("c"), F.col("wrong").cast("long").alias("wrong"))
    ranged = written(keyed.repartitionByRange("c", "id").withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p")  # one row for each range
    base = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.sum("wrong").alias("w")).select("_p", (F.sum("n").over(before) - F.col("n")).alias("bn"), (F.sum("w").over(before) - F.col("w")).alias("bw"))
    own = Window.partitionBy("_p").orderBy("c", "id")
    return ranged.join(F.broadcast(base), "_p").select("id", (F.col("bn") + F.row_number().over(own)).alias("k"), (F.col("bw") + F.sum("wrong").over(own)).alias("errors"))


def risk_grid(judged: DataFrame, grid: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """(coverage, kept, errors, risk) at each coverage of the grid, the most confident rows kept, rounded up; judged: id, confidence, wrong (0 or 1)."""
    rows = _running(judged)
    n = rows.agg(F.count("*").alias("n"))  # one row
    wanted = n.select(F.explode(F.array(*map(F.lit, grid))).alias("coverage"), "n").select("coverage", F.ceil(F.round(F.col("coverage") * F.col("n"), 6)).cast("long").alias("kept"))
    hit = F.broadcast(wanted).join(rows, F.col("kept") == F.col("k"))
    return hit.select("coverage", "kept", "errors", (F.col("errors") / F.col("kept")).alias("risk"))


def aurc(judged: DataFrame) -> DataFrame:
    """One row (n, aurc): the mean risk over all coverages 1/n, 2/n, ..., 1; lower is better, null without rows."""
    return _running(judged).agg(F.count("*").alias("n"), F.avg(F.col("errors") / F.col("k")).alias("aurc"))


def abstention(judged: DataFrame) -> DataFrame:
    """One row on a system that may abstain: coverage, accuracy where it does not, and the share of out-of-scope rows where it does.

    judged: gold, predicted, abstain, out_of_scope. Shares of nothing are null.
    """
    n = judged.agg(
        F.count("*").alias("n"), F.count_if(~F.col("abstain")).alias("answered"), F.count_if(~F.col("abstain") & (F.col("gold") == F.col("predicted"))).alias("right"),
        F.count_if("out_of_scope").alias("outside"), F.count_if(F.col("out_of_scope") & F.col("abstain")).alias("refused"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return n.select("n", "answered", share("answered", "n").alias("coverage"), share("right", "answered").alias("selective_accuracy"), share("refused", "outside").alias("abstention_recall"))


def ablation(grounded: DataFrame, found: DataFrame, papers: DataFrame, cites: DataFrame, now: int, rungs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(rung, request_id, paper, score, label): the best paper and label of each request when only a rung's features count.

    All rungs share one plan up to the features, and one label rule, so that they differ in features alone.
    """
    rows = R.scored(grounded, found, papers, cites, now)
    total = {}
    for rung, names in rungs.items():
        total[rung] = F.lit(0.0)
        for name, weight in R.WEIGHTS.items():
            if name in names:
                total[rung] = total[rung] + F.lit(weight) * F.col(f"features.{name}")
    each = rows.select("request_id", "paper", F.inline(F.array(*[F.struct(F.lit(r).alias("rung"), t.alias("score")) for r, t in total.items()])))
    best = each.groupBy("rung", "request_id").agg(F.min_by("paper", F.struct(-F.col("score"), F.col("paper"))).alias("paper"), F.max("score").alias("score"))
    label = F.when(F.col("score") >= 0.65, "WELL_EXPLORED").when(F.col("score") >= 0.4, "PARTIALLY_EXPLORED").when(F.col("score") > 0, "UNDERREPRESENTED").otherwise("UNKNOWN")
    return best.select("rung", "request_id", "paper", "score", label.alias("label"))


def citation_retrieval(seeds: DataFrame, cites: DataFrame, k: int = 10) -> DataFrame:
    """Top k papers of each request by citation links to its seed papers (request_id, rank, id, links); seeds: request_id, id; cites: a, b. Seeds are no answers."""
    both = cites.select("a", "b").union(cites.select("b", "a")).distinct()
    asked = seeds.select("request_id", "id").distinct()
    links = asked.join(both, F.col("id") == F.col("a")).groupBy("request_id", F.col("b").alias("id")).agg(F.count("*").alias("links"))
    others = links.join(asked, ["request_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("links"), "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("request_id", "rank", "id", "links")


def tag_retrieval(asked: DataFrame, tags: DataFrame, k: int = 10) -> DataFrame:
    """Top k papers of each request by shared tags, whatever their type (request_id, rank, id, shared); asked: request_id, tag; tags: id, tag."""
    hits = tags.distinct().join(asked.distinct(), "tag").groupBy("request_id", "id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("shared"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("request_id", "rank", "id", "shared")


def tension_papers(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(facet, claim, status, jaccard) of tensions in both: the share that their sets of papers (array) have in common; empty sets are equal."""
    keys = ["facet", "claim", "status"]
    both = gold.select(*keys, F.array_distinct("papers").alias("g")).join(found.select(*keys, F.array_distinct("papers").alias("f")), keys)
    union = F.size(F.array_union("g", "f"))
    return both.select(*keys, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("g", "f")) / union).alias("jaccard"))


def grounding_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row on facets matched one-to-one (gold, system columns of ``greedy_matching`` behind): gold and found hold facet; counts, precision, recall, unsupported and missing rates."""
    n = gold.agg(F.count("*").alias("n_gold")).join(F.broadcast(found.agg(F.count("*").alias("n_found"), F.count("gold").alias("matched"))))
    p, r = F.col("matched") / F.col("n_found"), F.col("matched") / F.col("n_gold")
    return n.select("n_gold", "n_found", "matched", p.alias("precision"), r.alias("recall"), (1 - p).alias("unsupported"), (1 - r).alias("missing"))


def tension_prf(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: true positives, precision, recall, f1 over distinct (facet, claim, status)."""
    keys = ["facet", "claim", "status"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "full_outer")
    n = both.agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count("g").alias("n_gold"), F.count("f").alias("n_found"))
    return n.select("tp", "n_gold", "n_found", (F.col("tp") / F.col("n_found")).alias("precision"), (F.col("tp") / F.col("n_gold")).alias("recall"), (F.lit(2.0) * F.col("tp") / (F.col("n_gold") + F.col("n_found"))).alias("f1"))


#: Rows of each side in one block of a search of all rows.
MEMBERS = 8192
QUERIES = 2048
#: Words of the queries of one broadcast block; queries that are scored at once.
POSTINGS = 1_000_000
ASKED = 256


def _blocks(members: DataFrame, queries: DataFrame, key: list[str], best, k: int) -> DataFrame:
    """Every query (query_id) against every member (id), block by block; ``best(m, q)`` gives a block's first k of each query (query_id, id, s)."""
    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {members.schema['id'].dataType.simpleString()}, s double"
    mb, qb = max(1, -(-members.count() // MEMBERS)), max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    m = members.withColumn("i", of("id", mb)).withColumn("j", every(qb))
    q = queries.withColumn("j", of("query_id", qb)).withColumn("i", every(mb))

    def meet(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = best(m, q) if len(m) and len(q) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": q["query_id"][:0], "id": m["id"][:0], "s": np.zeros(0)})

    met = m.groupBy(*key, "i", "j").cogroup(q.groupBy(*key, "i", "j")).applyInPandas(meet, ids)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id")


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "s", "id"], ascending=[True, False, True]).groupby("query_id").head(k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k documents of each query (request_id, rank, id); docs: id, text, told apart by id; queries: request_id, text, as many as there are.

    Word counts of documents are written once; blocks of queries, bounded by rows and words, are broadcast to them one after the other.
    Scores are exact and summed in the order of words, so that copies of a document tie.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>")).alias("ws")
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, "id"), (queries, "request_id"))}

    def count(frames):
        for f in frames:
            n = [Counter(ws) for ws in f["ws"]]
            yield pd.DataFrame({"id": f["id"], "len": f["ws"].str.len(), "w": [list(c) for c in n], "tf": [list(c.values()) for c in n]})

    members = written(docs.select("id", words).mapInPandas(count, f"id {kinds['id']}, len long, w array<string>, tf array<long>"), "words")
    stats = members.agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_words"))  # one row
    n_docs, n_words = stats.first()
    df = members.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    said = queries.where("request_id IS NOT NULL").select("request_id", F.explode(F.array_distinct(words)).alias("w")).distinct()
    asking = written(said.join(df, "w").select("request_id", "w", idf.alias("idf")), "asking")
    rows, asked = asking.agg(F.count("*"), F.count_distinct("request_id")).first()
    blocks = max(1, -(-asked // QUERIES), -(-rows // POSTINGS))
    found = []
    for block in range(blocks):
        # Bounded by QUERIES and POSTINGS.
        q = asking.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == block).toPandas().sort_values(["w", "request_id"])
        if len(q):
            code, vocabulary = pd.factorize(q["w"])
            ask, asks = pd.factorize(q["request_id"])
            sent = spark.sparkContext.broadcast((vocabulary.tolist(), asks.to_numpy(), code, ask, q["idf"].to_numpy()))
            found.append(members.where("id IS NOT NULL").mapInArrow(_scorer(sent, k, k1, b, n_docs, n_words), f"request_id {kinds['request_id']}, id {kinds['id']}, s double"))
    if not found:
        return spark.createDataFrame([], f"request_id {kinds['request_id']}, rank int, id {kinds['id']}")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("s"), "id")))
    return ranked.where(F.col("rank") <= k).select("request_id", "rank", "id")


def _scorer(sent, k: int, k1: float, b: float, n_docs: int, n_words: int):
    """Scores batches of documents for one block of queries: the first k of each query in a batch."""

    def run(batches):
        said, asks, theirs, ask, weight = sent.value
        keys = pa.array(said, pa.string())
        for batch in batches:
            lists, n = batch.column("w"), batch.num_rows
            code = pc.index_in(lists.flatten(), keys).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            tf, length = batch.column("tf").flatten().to_numpy(), batch.column("len").to_numpy()[row]
            part = tf * (k1 + 1), tf + k1 * (1 - b + b * length * n_docs / n_words)
            order = np.argsort(code, kind="stable")
            row, num, den = row[order], part[0][order], part[1][order]
            starts = np.searchsorted(code[order], np.arange(len(said) + 1))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo in range(0, len(asks), ASKED):
                mine = np.flatnonzero((ask >= lo) & (ask < lo + ASKED))
                at = np.flatnonzero(np.r_[True, np.diff(theirs[mine]) > 0, True]) if len(mine) else []
                score = np.zeros((min(ASKED, len(asks) - lo), n))
                for y, z in zip(at[:-1], at[1:]):
                    w = theirs[mine[y]]
                    c = slice(starts[w], starts[w + 1])
                    x = weight[mine[y]] * num[c] / den[c]
                    who = ask[mine[y:z]] - lo
                    if len(x) * 4 > n:
                        every = np.zeros(n)
                        every[row[c]] = x
                        score[who] += every
                    elif len(x):
                        score[np.ix_(who, row[c])] += x
                kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(score))
                r, c = np.nonzero((score >= kth[:, None]) & (score > 0))
                best = _first(pd.DataFrame({"query_id": asks[lo + r], "id": ids[c], "s": score[r, c]}), k)
                yield pa.RecordBatch.from_arrays([pa.array(best["query_id"]), pa.array(best["id"]), pa.array(best["s"], pa.float64())], names=["request_id", "id", "s"])

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact top k of all queries against all vectors of their length, in blocks: (query_id, rank, id); both sides: id, v.

    Vectors that are null, zero or not finite neither ask nor answer. Products of matrices only choose what may rank; sums in the order
    of components rank it, so that copies of a vector tie.
    """
    x = F.col("v")
    good = F.col("id").isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0), F.lit(False))
    usable = lambda d, name: d.select("id", F.col("v").cast("array<double>").alias("v")).where(good).select(F.col("id").alias(name), "v", F.size("v").alias("dim"))

    def scaled(v: pd.Series) -> np.ndarray:
        """By a power of two, which no digit is lost to and no square overflows."""
        a = np.array(v.tolist(), np.float64)
        return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None])

    def dot(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for n in range(a.shape[1]):
            total += a[:, n] * c[:, n]
        return total

    def best(m: pd.DataFrame, q: pd.DataFrame) -> list[pd.DataFrame]:
        a, y = scaled(m["v"]), scaled(q["v"])
        # Of equal vectors, no more than the first k ids and the query's own can matter.
        same = pd.DataFrame({"id": m["id"].to_numpy(), "cls": np.unique(a, axis=0, return_inverse=True)[1].ravel()})
        some = (same.groupby("cls")["id"].rank("dense") <= k + 1).to_numpy()
        a, ids, asks, out = a[some], m["id"].to_numpy()[some], q["query_id"].to_numpy(), []
        aa, yy = dot(a, a), dot(y, y)
        unit = a / np.sqrt(aa)[:, None]
        for lo in range(0, len(y), ASKED):
            near = (y[lo : lo + ASKED] / np.sqrt(yy[lo : lo + ASKED])[:, None]) @ unit.T
            near[asks[lo : lo + ASKED, None] == ids[None, :]] = -np.inf
            kth = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(near), -2.0)
            r, c = np.nonzero((near >= kth[:, None] - 1e-9) & (near > -np.inf))
            s = dot(a[c], y[lo + r]) / np.sqrt(aa[c] * yy[lo + r])
            out.append(_first(pd.DataFrame({"query_id": asks[lo + r], "id": ids[c], "s": s}), k))
        return out

    return _blocks(usable(vectors, "id"), usable(queries, "query_id"), ["dim"], best, k)


def greedy_matching(pairs: DataFrame, least: float) -> DataFrame:
    """One-to-one matching by descending similarity within each proposal; pairs: proposal, gold, system, similarity. A proposal has few facets."""

    def match(g: pd.DataFrame) -> pd.DataFrame:
        used_g, used_s, out = set(), set(), []
        for r in g.sort_values(["similarity", "gold", "system"], ascending=[False, True, True]).itertuples():
            if r.similarity >= least and r.gold not in used_g and r.system not in used_s:
                used_g.add(r.gold)
                used_s.add(r.system)
                out.append((r.proposal, r.gold, r.system, r.similarity))
        return pd.DataFrame(out, columns=["proposal", "gold", "system", "similarity"])

    return pairs.select("proposal", "gold", "system", "similarity").groupBy("proposal").applyInPandas(match, "proposal long, gold string, system string, similarity double")


def paired_bootstrap(differences: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean, two-sided 95 % bounds and one-sided 5th percentile of per-proposal differences (id, d), resampled by proposal.

    The differences are sent to every task (a test set; bounded at one million rows); resamples are dealt over tasks, each with its own seed.
    """
    spark = differences.sparkSession
    rows = differences.orderBy("id").limit(1_000_001).toPandas()
    if len(rows) > 1_000_000:
        raise ValueError("a paired bootstrap takes at most a million proposals")
    d = spark.sparkContext.broadcast(rows["d"].to_numpy())

    def draw(frames):
        for f in frames:
            out = [float(d.value[np.random.default_rng([seed, int(i)]).integers(0, len(d.value), len(d.value))].mean()) if len(d.value) else float("nan") for i in f["id"]]
            yield pd.DataFrame({"m": out})

    means = spark.range(resamples).mapInPandas(draw, "m double")
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.percentile("m", 0.05).alias("one_sided"))
