"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of every document.

A passage is a window of twice the longest item's words, at steps of half a window, so that an item inside a document lies
whole in one passage. Item weights are divided by the item's own score: a passage that holds all of an item's words
scores 1. Retrieval returns every item that scores at least ``threshold`` by block-max WAND: items are dealt into blocks of
neighbours, each term keeps its largest weight in each block, and blocks whose largest weights cannot reach the threshold for a
passage are never opened. In an open block the lists move from pivot to pivot. Every retrieved pair of passage and item is verified
by shared word shingles of the item's question (all but its last sentence) and answer (the last one).

Defined cases: null and empty documents match nothing; null or wordless items are no items; items and documents may
repeat, and each row gets its own result, rows with a null id included; items of equal score are all retrieved; without items nothing is
contaminated; other columns are never read. Items shorter than a shingle are one
shingle as a whole. Large item tables are searched in shards of bounded size, one after the other, each against all documents;
counts, document frequencies and mean length are those of all items, so results do not depend on the number of shards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import dropped, tidy, written

_WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Items of a block.
BLOCK = 4
#: Bytes of item text in one broadcast index.
SHARD_BYTES = 32 << 20
#: Passages times blocks that are bounded at once.
CELLS = 1 << 21


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    """Posting lists in item order with block maxima; weights are normalised by each item's own score.

    ``df``, ``count``, ``mean`` and ``longest`` describe all items, of which ``items`` may be a part; without them they are taken from ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], n: int, df: dict[str, int] | None = None, count: int | None = None, mean: float | None = None, longest: int | None = None):
        self.n = n
        kept = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        self.longest = longest or max((len(w) for _, _, w in kept), default=0)
        self.parts = []
        for _, text, w in kept:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if _WORD.search(s)]
            answer = words_of(sentences[-1])
            question = words_of(" ".join(sentences[:-1])) or answer
            self.parts.append((shingles(w, n), shingles(question, n), shingles(answer, n)))
        counts = [Counter(w) for _, _, w in kept]
        df = df or Counter(t for c in counts for t in c)
        count = count or len(kept)
        mean = mean or sum(len(w) for _, _, w in kept) / max(1, len(kept))
        self.term = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        post: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for j, (c, (_, _, w)) in enumerate(zip(counts, kept)):
            raw = {t: np.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in c.items()}
            total = sum(raw.values())
            for t, x in raw.items():
                post[self.term[t]].append((j, float(x / total)))
        self.blocks = -(-len(kept) // BLOCK)
        # Postings of each term by block, and for each term its blocks with their largest weights, in flat arrays.
        self.inside = [{} for _ in post]
        for p, by_block in zip(post, self.inside):
            for j, x in p:
                by_block.setdefault(j // BLOCK, []).append((j, x))
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.inside])]).astype(np.int64)
        self.block = np.array([b for x in self.inside for b in x], np.int64)
        self.most = np.array([max(x for _, x in p) for by_block in self.inside for p in by_block.values()], np.float64)
        #: Blocks that were bounded, blocks that were opened and items that were scored.
        self.work = np.zeros(3, np.int64)

    def open_blocks(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(passage, blocks that may hold an item at the threshold) for pairs of passage and distinct term, in order of passages."""
        if not len(passage):
            return
        n = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own, block, most = np.repeat(passage, n), self.block[at], self.most[at]
        each = max(1, CELLS // self.blocks)
        for lo in range(0, int(passage[-1]) + 1, each):
            a, b = np.searchsorted(own, [lo, lo + each])
            if a == b:
                continue
            bound = np.bincount((own[a:b] - lo) * self.blocks + block[a:b], most[a:b])
            self.work[0] += np.count_nonzero(bound)
            hit = np.flatnonzero(bound >= threshold - 1e-9)
            self.work[1] += len(hit)
            for p in np.unique(hit // self.blocks):
                yield lo + int(p), hit[hit // self.blocks == p] % self.blocks

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of the block that score at least ``threshold`` for the distinct ``terms``."""
        lists = [[0, p, max(x for _, x in p)] for t in terms if (p := self.inside[t].get(block))]
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]][0])
            bound, pivot = 0.0, -1
            for k, (_, _, most) in enumerate(lists):
                bound += most
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][1][lists[pivot][0]][0]
            if lists[0][1][lists[0][0]][0] == item:  # all lists up to the pivot stand at its item
                score = 0.0
                for x in lists:
                    j, weight = x[1][x[0]]
                    if j == item:
                        score += weight
                        x[0] += 1
                self.work[2] += 1
                if score >= threshold - 1e-9:
                    out.append((item, score))
            else:
                for x in lists[:pivot]:
                    while x[0] < len(x[1]) and x[1][x[0]][0] < item:
                        x[0] += 1
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def passages(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (passage, distinct known term), in order of passages. A word lies in the passage that starts at its step and in the one before."""
        get, step = self.term.get, max(self.n, self.longest)
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        own = at // step
        both = np.concatenate([own, own - 1]) * len(self.term) + np.concatenate([terms[at]] * 2)
        both = np.unique(both[both >= 0])
        return both // max(1, len(self.term)), both % max(1, len(self.term))

    def search(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float]]:
        """(item id, score, share of its shingles) of each item that a passage both retrieves and verifies, from its best such passage."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        step = max(self.n, self.longest)
        passage, term = self.passages(words)
        found: dict[int, tuple] = {}
        for p, blocks in self.open_blocks(passage, term, threshold):
            a, b = np.searchsorted(passage, [p, p + 1])
            terms, inside, cuts = term[a:b].tolist(), words[p * step : (p + 2) * step], {}
            for block in blocks.tolist():
                for j, score in self.wand(terms, block, threshold):
                    share = []
                    for s in self.parts[j]:
                        k = len(next(iter(s)))  # shorter for items or sentences of fewer words than a shingle
                        cuts[k] = cuts.get(k) or shingles(inside, k)
                        share.append(len(s & cuts[k]) / len(s))
                    if (share[0] >= overlap or min(share[1:]) >= overlap) and (j not in found or (share[0], score) > found[j][:2]):
                        found[j] = (share[0], score)
        return [(self.ids[j], score, share) for j, (share, score) in found.items()]


def _statistics(pool: DataFrame) -> tuple[DataFrame, tuple[int, float, int]]:
    """(w, df) of all items' words, and (items with words, their mean length, the longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in found], pa.list_(pa.string())), pa.array([len(w) for w in found], pa.int64())], names=["w", "n"])

    cut = pool.select("t").mapInArrow(run, "w array<string>, n long").where("n > 0")
    count, mean, longest = cut.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    return cut.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("df")), (count, mean or 0.0, longest or 0)


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, overlap: float = 0.8, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, contaminated, n_items, item_ids (ascending), best_score, best_overlap, and the columns named in ``carry``.

    An item counts where a passage retrieves it and holds at least ``overlap`` of its shingles, or of both its question's and its answer's.
    Carried columns travel with their row, so that a caller can filter documents without a join; their names must differ from the results'.
    """
    spark = docs.sparkSession
    pool = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = pool.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()[0]
    shards = max(1, -(-int(size) // SHARD_BYTES))
    df, (count, mean, longest) = _statistics(pool)
    carry = tuple(c for c in carry if c not in (id_col, text_col)) + ((text_col,) if text_col in carry else ())
    fields = [StructField("id", docs.schema[id_col].dataType), StructField("text", docs.schema[text_col].dataType)]
    fields += [StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry) if c != text_col]
    fields += [StructField("item_ids", ArrayType(LongType())), StructField("best_score", DoubleType()), StructField("best_overlap", DoubleType())]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text_col))
    rows = rows.select("*", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_score"), F.lit(0.0).alias("best_overlap"))
    for shard in range(shards):
        # Bounded by SHARD_BYTES, as items are dealt evenly; of the words only those of the shard's items come along.
        own = pool.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard)
        part = [(r["i"], r["t"]) for r in own.orderBy("i", "t").collect()]
        terms = _statistics(own)[0].select("w") if shards > 1 else None
        freq = {r["w"]: r["df"] for r in (df if terms is None else df.join(terms, "w", "left_semi")).collect()}
        index = spark.sparkContext.broadcast(Index(part, words, freq, count, mean, longest))
        last = shard == shards - 1
        # The text goes no further than it is needed.
        schema = StructType([f for f in fields if f.name != "text" or not last or text_col in carry])

        def run(batches: Iterator[pa.RecordBatch], index=index, schema=schema) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                hits = [ix.search(t.as_py(), threshold, overlap) for t in batch.column(1)]
                old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("item_ids", "best_score", "best_overlap")]
                made = {
                    "item_ids": pa.array([sorted({*x, *(h[0] for h in own)}) for x, own in zip(old[0], hits)], pa.list_(pa.int64())),
                    "best_score": pa.array([max([x, *(h[1] for h in own)]) for x, own in zip(old[1], hits)], pa.float64()),
                    "best_overlap": pa.array([max([x, *(h[2] for h in own)]) for x, own in zip(old[2], hits)], pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in schema.names], names=schema.names)

        before, rows = rows, rows.mapInArrow(tidy(run), schema)
        if not last:  # one shard's index at a time is in a worker's memory
            rows = written(rows, "shard")
        if 0 < shard < shards - 1:
            dropped(before)
    kept = [F.col("text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(carry)]
    return rows.select(F.col("id").alias(id_col), (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_score", "best_overlap", *kept)
