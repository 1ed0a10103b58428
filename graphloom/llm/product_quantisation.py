"""Near-duplicate embeddings by product quantisation with coarse inverted lists.

Vectors are scaled to length 1. Equal vectors are one class. Coarse centroids and the codebooks of residual subspaces are fitted on
a bounded sample; every class goes into its nearest centroid's list with one code for each subspace. Every class also probes its
``probes`` nearest lists: asymmetric table look-ups give the distance of the query to all codes of the list, and whatever could lie
within the angle, with the list's largest coding error as margin, is confirmed by the exact cosine in double precision.
Blocks of queries meet blocks of list members, count their links and return a spanning forest of them, never all pairs. A pair that only one of the
two probes for counts at both ends all the same.

Defined cases: null vectors, vectors of length zero or with null or non-finite components link with nothing; equal vectors link with
each other; vectors are compared with those of their own length only; rows that repeat an id are vectors of their own, and rows without an id
have no component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, lowest, tidy, written

#: Bounds: vectors that fit centroids and codebooks; lists; members of a list and queries in one block.
SAMPLE = 16_384
MAX_LISTS = 4096
LIST_SIZE = 128
MEMBERS = 4096
QUERIES = 2048
PARTS = 8
CODES = 64
PROBES = 32
#: Vector lengths that have an index of their own.
LENGTHS = 64


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m nearest rows of c, nearest first, ties by index."""
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    m = min(m, len(c))
    if m == 1:
        return d.argmin(1)[:, None]
    some = np.argpartition(d, m - 1, axis=1)[:, :m]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


class Index:
    """Coarse centroids and residual codebooks of one vector length; at most MAX_LISTS x length + CODES x length numbers."""

    def __init__(self, x: np.ndarray, total: int):
        lists = int(min(MAX_LISTS, max(1, total // LIST_SIZE), max(1, len(x) // 4)))
        self.coarse = kmeans(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), CODES, 6) for a, b in zip(self.cuts, self.cuts[1:])]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out."""
        rest = x - self.coarse[lists]
        code = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1)
        made = np.hstack([book[code[:, i]] for i, book in enumerate(self.books)])
        return code.astype(np.uint8), np.linalg.norm(rest - made, axis=1)

    def distances(self, q: np.ndarray, which: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of list ``which``: sums of table look-ups."""
        rest = q - self.coarse[which]
        out = np.zeros((len(q), len(code)), np.float32)
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            part = rest[:, a:b]
            table = ((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None, :]).astype(np.float32)
            out += table[:, code[:, i]]
        return np.sqrt(np.maximum(out, 0))


def _unit(column: list) -> np.ndarray:
    x = np.array(column, np.float64)
    # A power of two, near the largest component: no digit is lost and no square overflows or vanishes.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES) -> DataFrame:
    """Per vector: id, n_links (other vectors of at least that cosine), component_id (smallest id reachable), kept (id = component_id)."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    # Single-precision vectors travel as such and are compared in double precision.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("x"))
    usable = F.coalesce(F.size("x") > 0, F.lit(False)) & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = written(rows.withColumn("ok", usable & F.col("id").isNotNull()), "vectors")
    classes = written(keyed(rows.where("ok"), ["x"]).select("x", F.col("key").alias("rep"), F.col("m").alias("n"), F.col("rep").alias("first")), "classes")
    found, links = [], []
    # The most frequent lengths have an index each; all others are compared without one, in a single pass.
    frequent = sorted(classes.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect())
    rare = classes.where(~F.size("x").isin([dim for dim, _ in frequent]))
    if len(frequent) == LENGTHS and not rare.isEmpty():
        f, e = _rare_lengths(rare, cosine)
        found.append(f)
        links.append(e)
    for dim, total in frequent:
        own = classes.where(F.size("x") == dim)
        taken = own.orderBy(F.xxhash64("x"), "rep").limit(SAMPLE).select("x").toPandas()  # bounded by SAMPLE
        index = spark.sparkContext.broadcast(Index(_unit(taken["x"].tolist()), total))  # bounded by MAX_LISTS and CODES
        f, e = _one_length(own, index, cosine, probes)
        found.append(f)
        links.append(e)
    none = rows.where("NOT ok").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found:
        comp = components(reduce(DataFrame.unionByName, links))
        per_class = classes.join(reduce(DataFrame.unionByName, found), "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
        per_class = per_class.select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.col("rep").alias("key"), F.col("first").alias("rep"), F.coalesce("component_id", "rep").alias("root"))
        good = rows.where("ok").join(lowest(per_class).select("x", "n_links", "root"), "x")
        none = none.unionByName(good.select(F.col("id").alias(id_col), "n_links", F.col("root").alias("component_id")))
    return none.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _rare_lengths(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """As ``_one_length`` for all lengths at once: blocks of the classes of a length meet each other, without an index."""
    sized = classes.withColumn("dim", F.size("x"))
    blocks = sized.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    dealt = written(sized.join(blocks, "dim").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "rare")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = dealt.select("dim", F.col("own").alias("i"), other.alias("j"), "rep", "n", "x")
    asking = dealt.select("dim", other.alias("i"), F.col("own").alias("j"), "rep", "x")

    def meet(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        total, tree, root = np.zeros(len(q), np.int64), [], {}
        if m.empty or q.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        x, y = _unit(m["x"].tolist()), _unit(q["x"].tolist())
        ids, n, qs = m["rep"].to_numpy(), m["n"].to_numpy(), q["rep"].to_numpy()
        for lo in range(0, len(qs), 512):
            r, c = np.nonzero((y[lo : lo + 512] @ x.T >= cosine) & (qs[lo : lo + 512, None] != ids[None, :]))
            np.add.at(total, lo + r, n[c])
            for a, b in zip(qs[lo + r].tolist(), ids[c].tolist()):
                ra, rb = top(a), top(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    tree.append((a, b))
        out = [(a, b, 0) for a, b in tree] + list(zip(qs[total > 0].tolist(), qs[total > 0].tolist(), total[total > 0].tolist()))
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    met = written(members.groupBy("dim", "i", "j").cogroup(asking.groupBy("dim", "i", "j")).applyInPandas(meet, "a long, b long, links long"), "rare-met")
    return met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")), met.where("a <> b").select("a", "b")


def _one_length(classes: DataFrame, index, cosine: float, probes: int) -> tuple[DataFrame, DataFrame]:
    """Of classes of one length: (rep, links) and a spanning forest (a, b) of the links."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2).to_pylist())
            near = nearest(x, ix.coarse, probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["rep", "n", "x", "near"])

    near = written(classes.select("rep", "n", "x").mapInArrow(tidy(assign), f"rep long, n long, x {classes.schema['x'].dataType.simpleString()}, near array<int>"), "near")
    sizes = near.groupBy(F.col("near")[0].alias("l")).agg(F.count("*").alias("members"))
    members = near.withColumn("l", F.col("near")[0])
    asking = near.select("rep", "n", "x", F.col("near")[0].alias("home"), F.explode("near").alias("l"))
    asked = asking.groupBy("l").agg(F.count("*").alias("queries"))
    # One row for each list: at most MAX_LISTS.
    plan = written(sizes.join(asked, "l").select("l", F.ceil(F.col("members") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("qb")), "lists")
    block = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    none = F.array().cast("array<int>")
    m = members.join(F.broadcast(plan), "l").select("l", block("mb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), "rep", "n", "x", "near", F.lit(-1).alias("home"))
    q = asking.join(F.broadcast(plan), "l").select("l", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), block("qb").alias("j"), "rep", "n", "x", none.alias("near"), "home")
    reach = np.sqrt(2 - 2 * cosine)

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        ix, which = index.value, int(g["l"].iat[0])
        mine, ask = g[g["home"] < 0], g[g["home"] >= 0]
        if mine.empty or ask.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        x, y = _unit(mine["x"].tolist()), _unit(ask["x"].tolist())
        ids, n, qs, weight = mine["rep"].to_numpy(), mine["n"].to_numpy(), ask["rep"].to_numpy(), ask["n"].to_numpy()
        code, left = ix.codes(x, np.full(len(x), which))
        total, back, tree, root = np.zeros(len(qs), np.int64), np.zeros(len(ids), np.int64), [], {}
        # Does a member probe the query's own list? Then it finds the pair there itself; else it is counted here for both.
        homes, home = np.unique(ask["home"].to_numpy(), return_inverse=True)
        probed = np.zeros((len(ids), len(homes)), bool)
        for k, lists in enumerate(mine["near"]):
            probed[k] = np.isin(homes, lists)

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for lo in range(0, len(qs), 512):
            part = y[lo : lo + 512]
            # Distance of query and member <= distance of query and code + what the code leaves out, so none within reach is missed here.
            r, c = np.nonzero(ix.distances(part, which, code) <= (reach + left + 1e-4)[None, :])
            for at in range(0, len(r), 100_000):
                rr, cc = r[at : at + 100_000], c[at : at + 100_000]
                hit = (np.einsum("ij,ij->i", part[rr], x[cc]) >= cosine) & (qs[lo + rr] != ids[cc])
                rr, cc = rr[hit], cc[hit]
                np.add.at(total, lo + rr, n[cc])
                alone = ~probed[cc, home[lo + rr]]
                np.add.at(back, cc[alone], weight[lo + rr[alone]])
                for a, b in zip(qs[lo + rr].tolist(), ids[cc].tolist()):
                    ra, rb = top(a), top(b)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        tree.append((a, b))
        out = [(a, b, 0) for a, b in tree]
        for who, count in ((qs, total), (ids, back)):
            out += zip(who[count > 0].tolist(), who[count > 0].tolist(), count[count > 0].tolist())
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    met = written(m.unionByName(q).groupBy("l", "i", "j").applyInPandas(meet, "a long, b long, links long"), "met")
    return met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")), met.where("a <> b").select("a", "b")
