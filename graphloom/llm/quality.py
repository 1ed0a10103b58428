"""Quality by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text. Preference pairs (a labelled good text over a labelled bad one) teach
the weights by logistic loss on the difference of their features: all labelled rows and all their pairs, by sums that Spark makes. A sum over pairs
needs no pairs, as it depends on their worths alone: rows are spread over the nodes of a grid of worths by cubic interpolation, which
gives the logistic function of each pair to within 1e-6. The worth at which the labelled rows' share of bad texts lies
below, an exact score quantile, is put at the threshold. Sums are those of whole numbers, so that no order of rows matters.

Defined cases: null and empty texts have the features of no words; without labels of both kinds every score is 0.5;
repeated rows are scored alike; rows with a null id or label teach nothing, an id with several labels teaches each of them once; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, tidy, written

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?\-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_STOPS = re.compile(r"[.!?]")
NAMES = ("log_words", "symbols", "upper", "digits", "distinct", "top_word", "repeats", "word_length", "stops", "lines", "odd_words", "common_words", "no_words")
#: Weights: each feature, its square, and what it exceeds one deviation by.
WIDE = 3 * len(NAMES)
#: Distance of the nodes in the grid of worths; pairs more than FAR nodes apart have the logistic function's limits.
STEP, FAR = 0.125, 320
#: Sums are kept in units of 1 / UNIT.
UNIT = float(1 << 24)
#: The pull of the weights towards 0, and the steepest slope at which they are settled.
RIDGE, FLAT = 1e-3, 1e-4


def features(text: str | None) -> list[float]:
    """NAMES of a whole text; rates lie in 0..1 or are square roots of such, so that rare signs weigh."""
    words = (text or "").split()
    n, chars = len(words), max(1, len(text or ""))
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    pairs = sum(map(str.__eq__, words, words[1:]))
    expected = min(1.0, 6 / n**0.5)  # long texts repeat words by nature
    symbols = len(_SYMBOLS.findall(text))
    return [
        min(1.0, np.log1p(n) / 10), min(1.0, (symbols / chars) ** 0.5), min(1.0, (len(_UPPER.findall(text)) / chars) ** 0.5), min(1.0, (len(_DIGIT.findall(text)) / chars) ** 0.5),
        min(1.0, len(count) / n / expected), max(count.values()) / n, (pairs / n) ** 0.5, min(1.0, sum(map(len, count)) / len(count) / 20), min(1.0, len(_STOPS.findall(text)) / n * 4),
        min(1.0, text.count("\n") / n * 4), sum(1 for w in count if not w.strip(".,;:'\"()?").isalpha()) / len(count), sum(1 for c in count.values() if c > 1) / len(count), 0.0,
    ]


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, at: float = 0.0, steep: float = 1.0):
        self.mean, self.scale, self.weights, self.at, self.steep = mean, scale, weights, at, steep

    def wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z, np.maximum(0, z - 1)])

    def worth(self, x: np.ndarray) -> np.ndarray:
        return (self.wide(x) * self.weights).sum(1)  # row by row, whatever else is in the batch

    def score(self, worth: np.ndarray, threshold: float) -> np.ndarray:
        z = self.steep * (worth - self.at) + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _by_key(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows, which are whole numbers."""
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    return key, np.add.reduceat(values[order], first, axis=0) if len(key) else values[:0]


def _totals(taught: DataFrame, width: int, run: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order, and the sum of each key's rows of ``width`` numbers that ``run`` makes of features and labels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = np.empty(0, np.int64), np.empty((0, width), np.int64)
        for batch in batches:
            k, v = run(_features(batch.column(0)), batch.column(1).to_numpy())
            key, held = _by_key(np.concatenate([key, k.astype(np.int64)]), np.concatenate([held, np.rint(v * UNIT).astype(np.int64)]))
        at = (key[:, None] * width + np.arange(width)).ravel()
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000]), pa.array(held.ravel()[lo : lo + 100_000])], names=["k", "v"])

    # One row for each key and column; keys are kinds of labels, or nodes of the grid.
    got = taught.select("f", "y").mapInArrow(tidy(each), "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    return got["k"].to_numpy(np.int64)[::width] // width, got["v"].to_numpy(np.int64).reshape(-1, width) / UNIT


def spread(worth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, share) four times: a smooth function's values at the nodes, times their shares, add up to its value at the worth."""
    low = np.floor(worth / STEP)
    t = worth / STEP - low
    for node, share in zip(range(-1, 3), (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)):
        yield low.astype(np.int64) + node, share


def beaten(count: np.ndarray) -> np.ndarray:
    """For each node the sum over all nodes of ``count`` times the logistic function of how far they lie above it."""
    near = 1 / (1 + np.exp(-STEP * np.arange(-FAR, FAR + 1)))
    up_to = np.cumsum(count)
    return np.correlate(np.pad(count, FAR), near, "valid") + up_to[-1] - up_to[np.minimum(np.arange(len(count)) + FAR, len(count) - 1)]


def slope(taught: DataFrame, model: Model) -> np.ndarray:
    """The gradient by the weights of the logistic loss, averaged over all pairs of a good and a bad row."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = x[(y == 0) | (y == 1)], y[(y == 0) | (y == 1)]
        z = np.hstack([np.ones((len(x), 1)), model.wide(x)])
        made = [(node * 2 + y, share[:, None] * z) for node, share in spread(model.worth(x))]
        return np.concatenate([k for k, _ in made]), np.concatenate([v for _, v in made])

    key, sums = _totals(taught, 1 + WIDE, run)
    low = key.min() >> 1
    grid = np.zeros((2, (key.max() >> 1) - low + 1, 1 + WIDE))
    grid[key & 1, (key >> 1) - low] = sums
    bad, good = grid
    lost, won = beaten(bad[:, 0]), beaten(good[::-1, 0])[::-1]
    return (won @ bad[:, 1:] - lost @ good[:, 1:]) / (good[:, 0].sum() * bad[:, 0].sum())


def ranked(rows: DataFrame, column: str, rank: int) -> float:
    """The value with ``rank`` others before it in ascending order: ranges that hold it are counted and narrowed until one value is left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        part = F.least(F.floor((F.col(column) - low) / ((high - low) / 1024)), F.lit(1023))
        inside = rows.where(F.col(column).between(low, high)).groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.min(column).alias("a"), F.max(column).alias("z"))
        for r in sorted(inside.collect()):  # 1024 rows at most
            if rank < r["c"]:
                low, high = r["a"], r["z"]
                break
            rank -= r["c"]
    return low


def fit(taught: DataFrame, rounds: int = 60) -> Model | None:
    """The model of all rows (f: features, y: label 1 for good, 0 for bad): the least loss over all pairs, found by BFGS. None without rows of both kinds."""
    kind = lambda y: np.where((y == 0) | (y == 1), y, 2)
    kinds, sums = _totals(taught, 1 + 2 * len(NAMES), lambda x, y: (kind(y), np.hstack([np.ones((len(x), 1)), x, x * x])))
    if not {0, 1} <= set(kinds.tolist()):
        return None
    n, mean, square = sums[:, 0].sum(), *np.split(sums[:, 1:].sum(0) / sums[:, 0].sum(), 2)
    model = Model(mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-3, np.zeros(WIDE))

    def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.rint(np.hstack([np.ones((len(x), 1)), model.wide(x)]) * UNIT**0.5)  # whole numbers, so their products are
        return np.arange(3), np.array([(z[kind(y) == k].T @ z[kind(y) == k]).ravel() for k in range(3)]) / UNIT

    bad, good = (m.reshape(1 + WIDE, 1 + WIDE) / m[0] for m in _totals(taught, (1 + WIDE) ** 2, moments)[1][:2])
    # The second moments of the difference between a good and a bad row.
    both = good[1:, 1:] + bad[1:, 1:] - np.outer(good[0, 1:], bad[0, 1:]) - np.outer(bad[0, 1:], good[0, 1:])
    both = (both + both.T) / 2
    size = np.sqrt(np.maximum(0, np.diag(both)))  # each difference on its own scale
    scale = np.where(size > 1e-3, 1 / np.maximum(size, 1e-3), 0.0)
    w = np.zeros(WIDE)

    def at(w: np.ndarray) -> np.ndarray:
        model.weights = w * scale
        return slope(taught, model) * scale + RIDGE * w

    # The loss curves nowhere more than at 0, so that the first steps are safe.
    curve = np.linalg.inv(both * np.outer(scale, scale) / 4 + RIDGE * np.eye(WIDE))
    g, step = at(w), 1.0
    way = -curve @ g
    for _ in range(rounds):
        if np.abs(g).max() < FLAT:
            break
        new = at(w + step * way)
        before, behind = g @ way, new @ way
        if behind > -before / 2:  # too far along the way
            step *= before / (before - behind)
            continue
        s, d = step * way, new - g
        rho = 1 / (s @ d)
        turn = np.eye(WIDE) - rho * np.outer(s, d)
        curve = turn @ curve @ turn.T + rho * np.outer(s, s)
        w, g, step = w + s, new, 1.0
        way = -curve @ g
    model.weights = w * scale

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.worth(_features(batch.column(0))))], names=["worth"])

    rows = written(taught.select("f").mapInArrow(tidy(worths), "worth double"), "worths")
    whole = lambda c: F.sum(F.rint(c * UNIT).cast("decimal(28,0)")).cast("double") / UNIT / n
    m, q = rows.agg(whole(F.col("worth")), whole(F.col("worth") * F.col("worth"))).first()
    bads = int(sums[kinds == 0, 0][0])  # the quantile of their share lies midway between the worths of these ranks
    model.at = (ranked(rows, "worth", bads - 1) + ranked(rows, "worth", bads)) / 2
    model.steep = 2.0 / (max(0.0, q - m * m) ** 0.5 + 1e-9)
    dropped(rows)
    return model


def quality(docs: DataFrame, labels: DataFrame, teaching: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Per document: id, score (0 to 1; the quantile's worth scores ``threshold``), worth. Learns from all labelled rows where ``teaching`` holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist())
            f = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f], names=["i", "t", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = written(docs.select(F.col(id_col), F.coalesce(teaching, F.lit(False)).alias("t"), F.col(text_col)).mapInArrow(tidy(read), f"i {kind}, t boolean, f array<double>"), "features")
    y = labels.where(teaching).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").distinct()
    taught = written(table.where("t").join(y, "i").select("f", "y"), "taught")
    model = fit(taught)
    dropped(taught)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = _features(batch.column(1))
            worth = m.worth(x) if m else np.zeros(len(x))
            score = m.score(worth, threshold) if m else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(worth)], names=[id_col, "score", "worth"])

    return table.select("i", "f").mapInArrow(tidy(run), f"{id_col} {kind}, score double, worth double")
