"""Language identification by interpolated Kneser-Ney character models, one for each language.

Letters are lower-cased and every other run of characters becomes one blank; each document is its own stream with blanks
at both ends. Counts of 4-grams come from every teaching row, summed by Spark; lower orders use Kneser-Ney
continuation counts. The finished log-probabilities of each order, from four characters down to one, are kept in sorted arrays of the
grams' 64-bit keys, with the back-off weights of their contexts; what is seen in no language backs off to the order below. An order
beyond ``MOST`` values stays in tables: the workers then hold only the finished values of the most frequent 4-grams, and
a document's other 4-grams are finished by joins with the tables of all orders, so that every gram has the same value either way.
A text gets the language of the lowest cross-entropy for a character. It is rejected where that
cross-entropy lies more than ``sigmas`` standard deviations above the mean of its language's teaching rows, with the
chance error of its own length added.

Defined cases: null texts and texts without a letter get ``und``, score 0 and are rejected; ties go to the language that is
first in the alphabet; without teaching rows every text gets ``und``; repeated rows and rows without an id are scored alike, each for itself; other
columns are not read. Characters are UTF-16 codes, so a letter beyond the basic plane is two of them and shares them with no other letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import dropped, tidy, written

DISCOUNT = 0.75
#: Values that an order of the model holds at most: its grams times the languages. The rest is looked up by joins.
MOST = 1 << 23
#: Values that are looked up at once.
CELLS = 1 << 22
#: Joined values are summed in units of 1 / UNIT, so that their order does not matter.
UNIT = float(1 << 28)
_FOLD = None


def _fold() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or blank."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.full(65536, 32, np.uint16)
        for c in range(65536):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                _FOLD[c] = ord(low[0]) & 0xFFFF
    return _FOLD


def _folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    out = _fold()[codes]
    at = np.flatnonzero((codes[:-1] & 0xFC00 == 0xD800) & (codes[1:] & 0xFC00 == 0xDC00))
    if len(at):  # letters beyond the basic plane
        pairs, own = np.unique(codes[at].astype(np.uint32) << 16 | codes[at + 1], return_inverse=True)
        letter = [chr(0x10000 + ((p >> 16 & 0x3FF) << 10) + (p & 0x3FF)) for p in pairs.tolist()]
        low = np.array([np.frombuffer(c.lower().encode("utf-16-le"), np.uint16)[:2] if c.isalpha() else (32, 32) for c in letter], np.uint16)
        out[at], out[at + 1] = low[own, 0], low[own, 1]
    return out


def letters(text: str | None) -> np.ndarray:
    """The text's folded characters as 16-bit codes, with one blank at both ends and between words; empty without letters."""
    if not text:
        return np.empty(0, np.uint16)
    out = _folded(text)
    blank = out == 32
    if blank.all():
        return np.empty(0, np.uint16)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    out = out[keep]
    out = out[1:] if out[0] == 32 else out
    out = out[:-1] if out[-1] == 32 else out
    return np.concatenate([[32], out, [32]]).astype(np.uint16)


def grams(codes: np.ndarray) -> np.ndarray:
    """4-grams as 64-bit numbers, the oldest character highest; the stream starts with three blanks."""
    c = np.concatenate([np.full(2, 32, np.uint64), codes.astype(np.uint64)])
    s = np.uint64(16)
    return ((c[:-3] << s | c[1:-2]) << s | c[2:-1]) << s | c[3:]


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, g, n): how often each 4-gram occurs in each language, over all rows. Tasks sum what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        wait: dict[str, list[np.ndarray]] = {}

        def settle(lang: str) -> None:
            g, n = np.unique(np.concatenate(wait.pop(lang)), return_counts=True)
            if lang in held:
                both = np.concatenate([held[lang][0], g])
                g, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
            held[lang] = g, n

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(wait):
                settle(lang)
            for lang, (g, n) in held.items():
                for lo in range(0, len(g), 100_000):
                    part = g[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[lo : lo + 100_000].astype(np.int64))], names=["lang", "g", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = letters(text)
                if len(codes) and lang is not None:
                    wait.setdefault(lang, []).append(grams(codes))
                    if sum(map(len, wait[lang])) > 2_000_000:
                        settle(lang)
            if sum(len(g) for g, _ in held.values()) > 3_000_000:  # memory stays bounded; the rest is summed by Spark
                yield from flush()
        yield from flush()

    return docs.select(text_col, lang_col).mapInArrow(tidy(run), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


class Model:
    """By order 1 to 4: sorted keys of grams with log-probabilities by language, and of contexts with back-off weights. Every kept gram has a value in every language.

    Where an order is too large, ``tables`` holds (probabilities, contexts) of every order, and the arrays only the most frequent 4-grams.
    """

    def __init__(self, langs: list[str], floor: np.ndarray):
        self.langs, self.floor, self.keys, self.values, self.contexts, self.weights = langs, floor, {}, {}, {}, {}
        self.tables: dict[int, tuple[DataFrame, DataFrame | None]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}  # tables stay on the driver

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def backed(self, order: int, g: np.ndarray) -> np.ndarray:
        """What the order below says of the grams: the weight of their contexts with the probability of their last characters."""
        at, has = self._find(self.contexts[order], g >> np.uint64(16))
        weight = np.where(has[:, None], self.weights[order][at], np.float32(0)) if len(self.contexts[order]) else np.float32(0)
        return weight + self.logs(order - 1, g & np.uint64((1 << 16 * (order - 1)) - 1))

    def logs(self, order: int, g: np.ndarray) -> np.ndarray:
        at, has = self._find(self.keys[order], g)
        out = self.values[order][at] if len(self.keys[order]) else np.zeros((len(g), len(self.langs)), np.float32)
        if not has.all():
            out[~has] = self.backed(order, g[~has]) if order > 1 else self.floor
        return out

    def total(self, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The log-probability of the 4-grams, each ``n`` times, by language."""
        step = max(1, CELLS // len(self.langs))
        return sum((n[lo : lo + step] @ self.logs(4, g[lo : lo + step]) for lo in range(0, len(g), step)), np.zeros(len(self.langs)))

    def entropy(self, codes: np.ndarray) -> np.ndarray:
        """Cross-entropy in nats for a character, by language."""
        return -self.total(*np.unique(grams(codes), return_counts=True)) / max(1, len(codes) - 1)

    def held(self, g: np.ndarray) -> np.ndarray:
        """Which 4-grams have their values in the array of the most frequent ones."""
        return self._find(self.keys[4], g)[1]

    def finished(self, wanted: DataFrame) -> DataFrame:
        """(g, v) of the distinct 4-grams ``wanted``: what ``logs`` gives of a model that holds all tables, by joins with them."""
        # One row for each language.
        named = F.broadcast(wanted.sparkSession.createDataFrame([(x, i, float(f)) for i, (x, f) in enumerate(zip(self.langs, self.floor))], "lang string, i int, floor double"))
        asked = {4: wanted}
        for order in (3, 2, 1):
            asked[order] = written(asked[order + 1].select(F.col("g").bitwiseAND(_mask(order)).alias("g")).distinct(), "asked")
        below = None
        for order in (1, 2, 3, 4):
            p, ctx = self.tables[order]
            rows = asked[order].crossJoin(named).join(p.select("lang", "g", F.log("p").alias("own")), ["lang", "g"], "left")
            if order == 1:
                value = F.coalesce("own", "floor")
            else:
                rows = rows.withColumns({"low": F.col("g").bitwiseAND(_mask(order - 1)), "ctx": F.shiftrightunsigned("g", 16)})
                rows = rows.join(below.select("lang", F.col("g").alias("low"), F.col("v").alias("less")), ["lang", "low"])
                rows = rows.join(ctx.select("lang", "ctx", F.log(DISCOUNT * F.col("t") / F.col("s")).alias("weight")), ["lang", "ctx"], "left")
                value = F.coalesce("own", F.coalesce("weight", F.lit(0.0)) + F.col("less"))
            before, below = below, written(rows.select("lang", "i", "g", value.alias("v")), "values")
            if before is not None:
                dropped(before)
            if order < 4:
                dropped(asked[order])
        return below.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).select("g", F.col("x.v").alias("v"))


def _mask(order: int) -> Column:
    return F.lit((1 << 16 * order) - 1)


def _cutoff(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` grams (g, n) are counted that often in some language; from a histogram of 64 rows at most."""
    tall = counts.groupBy("g").agg(F.max("n").alias("n")).select(F.floor(F.log2("n")).cast("int").alias("p"))
    rows = {r["p"]: r["c"] for r in tall.groupBy("p").agg(F.count("*").alias("c")).collect()}
    p, left = 0, sum(rows.values())
    while left > most:
        left -= rows.get(p, 0)
        p += 1
    return 1 << p


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> Model | None:
    """The model of all rows with a language; None without any."""
    counts = written(gram_counts(docs, text_col, lang_col), "grams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    d, fit_in = F.lit(DISCOUNT), max(1, most // len(langs))
    # Continuation counts: in how many 4-grams of the language a 3-gram is the end, a pair the end of such 3-grams, and so on.
    by_order = {4: counts.select("lang", "g", "n")}
    for order in (3, 2, 1):
        by_order[order] = written(by_order[order + 1].groupBy("lang", F.col("g").bitwiseAND(_mask(order)).alias("g")).agg(F.count("*").alias("n")), "grams")
    sums = by_order[1].groupBy("lang").agg(F.sum("n").alias("s"), F.count("*").alias("t")).toPandas().set_index("lang")  # one row for each language
    floor = np.log([DISCOUNT * sums.at[x, "t"] / sums.at[x, "s"] / 65536 for x in langs]).astype(np.float32)
    model = Model(langs, floor)
    lower, tables, whole = None, {}, True
    for order in (1, 2, 3, 4):
        own, ctx = by_order[order], None
        if order == 1:
            # One row for each language.
            total = F.broadcast(own.groupBy("lang").agg(F.sum("n").alias("s"), F.count("*").alias("t")))
            p = own.join(total, "lang").select("lang", "g", "n", ((F.col("n") - d) / F.col("s") + d * F.col("t") / F.col("s") / 65536).alias("p"))
        else:
            placed = own.select("lang", "g", "n", F.shiftrightunsigned("g", 16).alias("ctx"), F.col("g").bitwiseAND(_mask(order - 1)).alias("low"))
            ctx = written(placed.groupBy("lang", "ctx").agg(F.sum("n").alias("s"), F.count("*").alias("t")), "contexts")
            p = placed.join(ctx, ["lang", "ctx"]).join(lower, ["lang", "low"]).select("lang", "g", "n", ((F.col("n") - d) / F.col("s") + d * F.col("t") / F.col("s") * F.col("q")).alias("p"))
            weight = ctx.select("lang", F.col("ctx").alias("g"), F.col("s").alias("n"), F.log(d * F.col("t") / F.col("s")).alias("v"))
            whole = whole and _cutoff(weight, fit_in) == 1
            if whole:
                model.contexts[order], model.weights[order] = _table(weight, langs, np.float32(0))
        p = written(p, "probabilities")
        tables[order] = p, ctx
        cut = _cutoff(p, fit_in)
        whole = whole and cut == 1
        if whole:
            model.keys[order], values = _table(p.select("lang", "g", F.log("p").alias("v")), langs, np.float32(np.nan))
            model.values[order] = values
            lost = np.isnan(values)
            if lost.any():  # seen in another language only: what the order below says there
                values[lost] = (model.backed(order, model.keys[order]) if order > 1 else np.broadcast_to(floor, values.shape))[lost]
        lower = p.select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
    if not whole:
        model = Model(langs, floor)
        model.tables = tables
        often = written(p.groupBy("g").agg(F.max("n").alias("top")).where(F.col("top") >= cut).select("g"), "often")
        got = model.finished(often).select("g", F.col("v").cast("array<float>").alias("v")).toArrow()  # fit_in rows at most
        keys = got["g"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        values = np.concatenate([np.empty(0, np.float32), *(c.flatten().to_numpy() for c in got["v"].chunks)])
        model.keys[4], model.values[4] = keys[order], values.reshape(-1, len(langs))[order]
    return model


def _table(rows: DataFrame, langs: list[str], fill: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, values by language) of rows (lang, g, v); the caller has counted that they fit."""
    got = rows.select("lang", "g", "v").toPandas()
    keys, at = np.unique(got["g"].to_numpy().astype(np.uint64), return_inverse=True)
    out = np.full((len(keys), len(langs)), fill, np.float32)
    out[at, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = got["v"].to_numpy()
    return keys, out


def _verdict(model: Model | None, total: np.ndarray | None, size: int, own: str | None) -> tuple[str, float, float | None, float | None, int]:
    """lang_pred, score, entropy, entropy in its own language, and characters, of a text with log-probabilities ``total`` by language."""
    if model is None or not size:
        return "und", 0.0, None, None, 0
    h = -total / max(1, size - 1)
    best = int(np.argmin(h))
    odds = np.exp(-(h - h[best]) * min(size, 50))
    return model.langs[best], float(1 / odds.sum()), float(h[best]), float(h[model.langs.index(own)]) if own in model.langs else None, size


def _joined(asked: DataFrame, model: Model, shared: Broadcast, at: list[int], schema: StructType, made: Callable[[list[tuple]], list[pa.Array]]) -> DataFrame:
    """What one pass over ``asked`` gives with a model that holds all grams: values that the workers lack come by joins, and meet their rows by a number of the row."""
    first = [schema[0], schema[1], StructField("row", LongType()), StructField("size", LongType()), StructField("total", ArrayType(DoubleType())), StructField("g", ArrayType(LongType())), StructField("n", ArrayType(LongType()))]
    first = StructType(first + schema.fields[7:])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            total, missing, often, size = [], [], [], []
            for text in batch.column(1):
                codes = letters(text.as_py())
                g, n = np.unique(grams(codes), return_counts=True) if len(codes) else (np.empty(0, np.uint64), np.empty(0, np.int64))
                has = m.held(g)
                total.append(m.total(g[has], n[has]))
                missing.append(g[~has].astype(np.int64))
                often.append(n[~has])
                size.append(len(codes))
            cols = [pa.array(range(row, row + len(size)), pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.list_(pa.float64())), pa.array(missing, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))]
            row += len(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols, *(batch.column(i) for i in at)], names=first.names)

    seen = written(asked.mapInArrow(tidy(part), first), "seen")
    missing = seen.select("row", F.explode(F.arrays_zip("g", "n")).alias("x")).select("row", "x.g", "x.n")
    wanted = written(missing.select("g").distinct(), "wanted")
    values = written(model.finished(wanted), "values")
    each = missing.join(values, "g").select("row", "n", F.posexplode("v").alias("i", "v"))
    each = each.groupBy("row", "i").agg(F.sum(F.rint(F.col("n") * F.col("v") * UNIT).cast("long")).alias("v"))
    rest = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("v") / UNIT).alias("v")))).alias("x")).select("row", F.col("x.v").alias("rest"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for own, size, total, rest in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                rows.append(_verdict(m, np.array(total) + (rest or 0.0), size, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made(rows), *batch.columns[5:]], names=schema.names)

    whole = seen.join(rest, "row", "left").select("id", "teaches", "size", "total", "rest", *schema.names[7:])
    scored = written(whole.mapInArrow(tidy(judge), schema), "langid")
    for table in (seen, wanted, values):
        dropped(table)
    return scored


def identify(docs: DataFrame, teaching: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sigmas: float = 6.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, lang_pred, score (0 to 1, the probability of the language at a fixed temperature), entropy, rejected.

    Learns from the rows where ``teaching`` holds and the language is not null. The columns named in ``carry`` travel with each
    row and come back behind the results, so that a caller can filter documents without a join; their names must differ from the results'.
    """
    spark = docs.sparkSession
    model = fit(docs.where(teaching & F.col(lang_col).isNotNull()), text_col, lang_col)
    shared = spark.sparkContext.broadcast(model)  # at most MOST values for each order, of grams and of contexts; tables stay
    sent = [id_col, text_col, *(c for c in carry if c not in (id_col, text_col))]
    at = [sent.index(c) + (sent.index(c) > 1) for c in carry]  # the teaching language stands third
    own = [("teaches", StringType()), ("lang_pred", StringType()), ("score", DoubleType()), ("entropy", DoubleType()), ("own", DoubleType()), ("n_letters", LongType())]
    schema = StructType([StructField("id", docs.schema[id_col].dataType)] + [StructField(c, t) for c, t in own] + [StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])

    def made(rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows)) or [[]] * 5
        return [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist()):
                codes = letters(text.as_py())
                total = m.total(*np.unique(grams(codes), return_counts=True)) if m and len(codes) else None
                rows.append(_verdict(m, total, len(codes), own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made(rows), *(batch.column(i) for i in at)], names=schema.names)

    asked = docs.select(*sent[:2], F.when(teaching, F.col(lang_col)).alias("teaches"), *sent[2:])
    if model and model.tables:
        scored = _joined(asked, model, shared, at, schema, made)
    else:
        scored = written(asked.mapInArrow(tidy(run), schema), "langid")
    # One row for each language.
    bounds = scored.where("own IS NOT NULL").groupBy(F.col("teaches").alias("lang_pred")).agg(F.avg("own").alias("mean"), F.coalesce(F.var_pop("own"), F.lit(0.0)).alias("var"))
    # One character's log-probability has a variance of about 4, so short texts get a wider bound.
    bound = F.col("mean") + sigmas * F.sqrt(F.col("var") + 4 / F.col("n_letters"))
    judged = scored.join(F.broadcast(bounds), "lang_pred", "left")
    rejected = (F.col("lang_pred") == "und") | F.coalesce(F.col("entropy") > bound, F.lit(False))
    return judged.select(F.col("id").alias(id_col), "lang_pred", "score", "entropy", rejected.alias("rejected"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c != id_col))
