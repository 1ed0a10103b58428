"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch holds the k smallest. Documents of equal
sets are one class, which has one key. The number of values that the sketches of two similar sets share is hypergeometric, so it has a floor that it
misses with a chance below 1e-8 (``floors``; none where the sets fit into their sketches). Of a sketch only the rarest values
beyond that floor go into inverted lists: boilerplate that fills less of a document never brings it into a list. Lists link
members to one leader, components form, and only members of different components are compared further, in blocks. Pairs pass an
estimate on the union's sketch, then the exact similarity of the full sets decides.

Sketches and texts are only shuffled where a pair or a block asks for them: a bounded filter of the asked keys stands ahead of each such join.

Defined cases: null texts and texts without words have an empty set and link with nothing; texts with fewer words than a
shingle are one shingle as a whole; rows that repeat an id are one document, which links with all that any of its texts links with;
rows without an id have no component and are not kept, and link with nothing; equal similarity needs no tie-break, as all pairs at the bound link; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, components, dropped, keyed, lowest, released, tidy, written

K = 128
#: Members of a list that are compared with each other at once; longer lists are dealt out as pairs of blocks.
BLOCK = 1000
#: Lists up to this size are compared together, about so many rows at once.
SMALL, BIN = 64, 128
#: Pairs whose sketches are set side by side at once, and cells of a block's matrix of pairs that are judged at once: they bound a worker's memory.
PAIRS, CELLS = 4000, 250_000
#: The chance that a similar pair shares fewer sketch values than its floor, and the set size from which the binomial bound holds.
MISS, TABLE = 1e-8, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    n = min(words, len(found))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def floors(k: int, percent: int) -> np.ndarray:
    """By set size (the last holds for all larger ones): the fewest of the union's k smallest values that a similar pair shares.

    For a union of u values, percent * u / 100 of them common, the common ones among its k smallest are hypergeometric. A set of n
    values meets unions of n to 100 * n / percent, so its floor is the least over these. Unions within k have no chance in them.
    """
    top = 100 * TABLE // percent + 1
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    quantile = np.zeros(top + 1, np.int64)
    for u in range(1, top + 1):
        both = -(-percent * u // 100)
        quantile[u] = both
        if u > k:
            x = np.arange(max(0, k - (u - both)), min(k, both) + 1)
            chance = log[both] - log[x] - log[both - x] + log[u - both] - log[k - x] - log[u - both - k + x] - (log[u] - log[k] - log[u - k])
            quantile[u] = x[np.searchsorted(np.cumsum(np.exp(chance)), MISS, "right")]
    out = np.array([quantile[n : 100 * n // percent + 1].min() for n in range(TABLE + 1)])
    x, p = np.arange(k + 1), percent / 100
    binomial = log[k] - log[x] - log[k - x] + x * np.log(p) + (k - x) * np.log1p(-p) if p < 1 else np.where(x == k, 0.0, -np.inf)
    out[-1] = np.searchsorted(np.cumsum(np.exp(binomial)), MISS, "right")
    return np.maximum(out, 1)


def sketches(docs: DataFrame, words: int, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, t, fp, sketch): size of the set, its floor, a 128-bit digest of it, and its k smallest hashes in ascending order as signed longs."""
    floor = floors(k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, cut = [], [], []
            for text in batch.column(1):
                own = shingle_hashes(text.as_py(), words)
                size.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own))
                cut.append(own[:k].astype(np.int64))  # a copy, so that the whole set goes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array([floor[min(n, TABLE)] for n in size], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(np.cumsum([0, *map(len, cut)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *cut])))],
                names=["id", "n", "t", "fp", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(run), "id long, n long, t long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, fp, s): the whole set and its digest, of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingle_hashes(t, words) for t in part.column(1).to_pylist()]
                flat = pa.array(np.concatenate([np.empty(0, np.int64), *(s.astype(np.int64) for s in sets)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), flat)], names=["id", "fp", "s"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, fp binary, s array<long>")


def estimate(a: np.ndarray, b: np.ndarray, whole: np.ndarray, floor: np.ndarray, percent: int) -> np.ndarray:
    """Rows of two padded sketch matrices (uint64, padding is the largest value): can the pair be similar?

    Sketches that are whole sets give their similarity; others must share ``floor`` of their union's k smallest values.
    """
    k = a.shape[1]
    both = np.sort(np.hstack([a, b]), axis=1)
    top = np.uint64(2**64 - 1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    rank = np.cumsum((both != top) & ~same, axis=1)
    exact = 100 * same.sum(1) >= percent * rank[:, -1]
    return np.where(whole, exact, (same & (rank <= k)).sum(1) >= floor)


def _matrix(column: list, k: int) -> np.ndarray:
    out = np.full((len(column), k), 2**64 - 1, np.uint64)
    for i, s in enumerate(column):
        out[i, : len(s)] = np.asarray(s, np.int64).astype(np.uint64)
    return out


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two padded matrices of distinct values: the smallest value that both hold, or the padding."""
    both = np.sort(np.hstack([a, b]), axis=1)
    top = np.uint64(2**64 - 1)
    return np.where(both[:, 1:] == both[:, :-1], both[:, 1:], top).min(axis=1, initial=top)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches let them be similar."""
    pairs = written(pairs, "asked")
    some = written(among(reps.select("key", "n", "t", "sketch"), "key", _ends(pairs)), "sketched")
    side = lambda c: some.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("t").alias(f"t_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                whole, floor = part.column(4).to_numpy() <= k, part.column(5).to_numpy()
                a, b = ([x.values.to_numpy() for x in part.column(i)] for i in (2, 3))
                ok = estimate(_matrix(a, k), _matrix(b, k), whole, floor, percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    good = written(sized.select("a", "b", "s_a", "s_b", F.greatest("n_a", "n_b"), F.greatest("t_a", "t_b")).mapInArrow(tidy(run), "a long, b long"), "pairs")
    dropped(some)
    dropped(pairs)
    return good


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a written table) whose full sets have 100 * intersection >= percent * union; docs: id, text."""
    asked = _ends(pairs)
    named = written(among(reps.select("key", "rep", "fp"), "key", asked).join(asked, "key", "left_semi"), "named")
    ids = named.select("rep").distinct()
    own = among(docs, "id", ids).join(ids, F.col("id") == F.col("rep"), "left_semi")
    # Of an id with several texts only the row with the class's own set counts; equal rows count once.
    sets = full_sets(own, words).join(named.select(F.col("rep").alias("id"), "fp", "key"), ["id", "fp"]).dropDuplicates(["key"])
    sets = written(sets.select("key", "s"), "sets")
    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    common = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    links = written(common.where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b"), "links")
    for table in (sets, named, pairs):
        dropped(table)
    return links


def compared(g: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of one pair of blocks (v, p, q, x, id, c, n, t, sketch, keys) in different components whose sketches let them be similar, and that belong to this list.

    The pairs are judged by strips of rows and by PAIRS, so that a block of copies takes no more memory than the matrix of its common values.
    """
    g = g.drop_duplicates("id").reset_index(drop=True)
    c, x, n, t, ids = (g[name].to_numpy() for name in ("c", "x", "n", "t", "id"))
    if (c == c[0]).all():
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    # Values that two sketches share, by products of 0/1 matrices over the values that occur twice in the block.
    m = _matrix(g["sketch"].tolist(), k)
    row, col = np.nonzero(m != np.uint64(2**64 - 1))
    _, value, count = np.unique(m[row, col], return_inverse=True, return_counts=True)
    often = count[value] > 1
    row, value = row[often], np.unique(value[often], return_inverse=True)[1]
    common = np.zeros((len(g), len(g)), np.float32)
    for lo in range(0, int(value.max(initial=-1)) + 1, 1024):
        mine = (value >= lo) & (value < lo + 1024)
        held = np.zeros((len(g), 1024), np.float32)
        held[row[mine], value[mine] - lo] = 1
        strip = max(1, CELLS // len(g))
        for at in range(0, len(g), strip):
            common[at : at + strip] += held[at : at + strip] @ held.T
    keys = _matrix(g["keys"].tolist(), max(map(len, g["keys"])))
    here = np.array([g["v"].iat[0]], np.int64).astype(np.uint64)[0]
    same, strip, out = g["p"].iat[0] == g["q"].iat[0], max(1, CELLS // len(g)), []
    for at in range(0, len(g), strip):
        own = slice(at, at + strip)
        wanted = c[own, None] != c[None, :]
        wanted &= np.arange(len(g))[own, None] < np.arange(len(g))[None, :] if same else x[own, None] < x[None, :]
        wanted &= 100 * np.minimum(n[own, None], n[None, :]) >= percent * np.maximum(n[own, None], n[None, :])
        i, j = np.nonzero(wanted & (common[own] >= np.maximum(t[own, None], t[None, :])))
        i += at
        for lo in range(0, len(i), PAIRS):
            y, z = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            mine = _first_common(keys[y], keys[z]) == here  # a pair that meets in several lists belongs to the first of them
            y, z = y[mine], z[mine]
            good = estimate(m[y], m[z], np.maximum(n[y], n[z]) <= k, np.maximum(t[y], t[z]), percent)
            out.append((ids[y[good]], ids[z[good]]))
    a, b = (np.concatenate([np.empty(0, np.int64), *(pair[e] for pair in out)]) for e in (0, 1))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).astype("int64")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = K, star_rounds: int = 2) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept (is its component's smallest)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = written(sketches(docs, words, k, percent, "id", "text"), "sketches")
    sk = written(whole.select("id", "n", "fp"), "digests")
    classes = written(keyed(sk.where("n > 0 AND id IS NOT NULL"), ["n", "fp"]), "classes")
    # A row whose set and id are its own alone stands for its class as it is; of the others one row is taken for each class.
    twice = classes.where("m > 1 OR key <> rep").select("n", "fp")
    copied = sk.join(twice, ["n", "fp"], "left_semi").select("id").union(sk.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    copied = written(copied.where("id IS NOT NULL").distinct(), "copied")
    flagged = among(whole, "id", copied, "maybe").where("n > 0 AND id IS NOT NULL")
    alone, maybe = flagged.where("NOT maybe"), flagged.where("maybe")
    # Only rows of a class's smallest id are joined, so that copies do not meet in one task.
    chosen = maybe.join(classes.select(F.col("rep").alias("id"), "n", "fp", "key"), ["id", "n", "fp"]).withColumn("rep", F.col("id")).dropDuplicates(["key"])
    columns = ("key", "rep", "fp", "n", "t", "sketch")
    reps = written(alone.select(F.col("id").alias("key"), F.col("id").alias("rep"), "fp", "n", "t", "sketch").unionByName(chosen.select(*columns)), "reps")
    for table in (whole, copied):  # of other rows only the digest is needed from here on
        dropped(table)
    values = reps.select(F.col("key").alias("id"), F.explode("sketch").alias("v"))
    shared = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    by_rarity = Window.partitionBy("id").orderBy("df", "v")
    ranked = values.join(shared, "v").select("id", "v", F.row_number().over(by_rarity).alias("r"), F.count("*").over(Window.partitionBy("id")).alias("m"))
    lists = written(ranked.join(reps.select(F.col("key").alias("id"), "t"), "id").where("m >= t AND r <= m - t + 1").select("v", "id", (F.col("m") - F.col("t")).alias("spare")), "lists")
    dropped(shared)
    # Rows of one id are one document, whatever their texts.
    members = sk.join(classes.select("n", "fp", "key"), ["n", "fp"]).select("id", "key")
    several = members.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("id", "a")
    edges = written(members.join(several, "id").where("key <> a").select("a", F.col("key").alias("b")).distinct(), "links")
    comp = None
    for turn in range(star_rounds):
        mine = lists.withColumn("c", F.col("id")) if comp is None else lists.join(comp, "id", "left").select("v", "id", "spare", F.coalesce("component_id", "id").alias("c"))
        # A list's leader is first the member that shares most values with others, later one by hash; members of other components are paired with it.
        order = [F.xxhash64("id", F.lit(turn))] if turn else [-F.col("spare")]
        lead = mine.groupBy("v").agg(F.min(F.struct(*order, "id", "c")).alias("l"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v", F.col("l.id").alias("a"), F.col("l.c").alias("ca"))
        stars = mine.join(lead, "v").where("c <> ca").groupBy(F.col("id").alias("b"), "a").agg(F.lit(1)).select("a", "b")
        good = _verified(_estimated(stars, reps, k, percent), docs, reps, words, percent)
        more = written(edges.unionByName(good), "links")
        for table in (edges, good):
            dropped(table)
        edges, comp = more, components(more)
    # What is left: members of one list in different components, compared in pairs of blocks; small lists together in bins.
    mine = lists.join(comp, "id", "left").select("v", "id", F.coalesce("component_id", "id").alias("c"))
    mixed = written(mine.groupBy("v").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v", "size"), "mixed")
    bins = 1 + (mixed.where(F.col("size") <= SMALL).agg(F.sum("size")).first()[0] or 0) // BIN
    part = mine.join(mixed, "v").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("x", (F.xxhash64("id") % F.col("blocks") + F.col("blocks")).cast("int") % F.col("blocks"))
    part = part.withColumn("v", F.when(F.col("size") <= SMALL, F.pmod(F.xxhash64("v"), F.lit(bins))).otherwise(F.col("v")))
    dealt = part.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("v", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "x", "id", "c").distinct()
    dealt = written(dealt, "dealt")
    keys = part.groupBy("id").agg(F.sort_array(F.collect_set("v")).alias("keys"))  # a sketch's values at most
    some = written(among(reps.select(F.col("key").alias("id"), "n", "t", "sketch"), "id", dealt.select("id").distinct()).join(keys, "id"), "sketched")
    dealt = dealt.join(some, "id")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out = compared(g, k, percent)
        if len(g) > BLOCK:  # small blocks leave little behind
            released()
        return out

    rest = written(dealt.groupBy("v", "p", "q").applyInPandas(compare, "a long, b long"), "pairs")
    dropped(some)
    last = _verified(rest, docs, reps, words, percent)
    comp = components(edges.unionByName(last))
    placed = classes.join(comp, F.col("key") == F.col("id"), "left").select("n", "fp", "rep", "key", F.coalesce("component_id", "key").alias("root"))
    rep_of = lowest(placed).select("n", "fp", "root")
    joined = sk.select("id", F.col("n").alias("n_shingles"), "n", "fp").join(rep_of, ["n", "fp"], "left")
    out = joined.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
