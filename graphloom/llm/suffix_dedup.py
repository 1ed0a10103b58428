"""Removal of repeated byte strings by difference-cover suffix arrays.

Every string of ``least`` bytes is assigned to one anchor: the leftmost least hash of the ``SEED``-byte strings in it. Equal
strings have equal anchors at equal offsets, so all strings that could repeat meet in the group of an anchor's hash.
A document's anchor record holds the region of all strings that chose it, long enough that longer strings (``length`` bytes) that start there lie in it
whole. Regions that are equal as a whole repeat throughout; of groups with different regions, each distinct region's bytes are fetched once and a
difference-cover suffix array, over the starts whose part (see below) has common bytes that stand in another of these regions too (triples at two of three offsets are named and sorted, the names are sorted by recursion, the remaining suffixes are
merged) puts equal strings side by side, where adjacent prefixes of both lengths are compared. Groups with very many
different regions are dealt over all tasks instead: their starts are cut into ever smaller parts by their place relative to the anchor. A part whose common bytes stand
nowhere else is dropped, one whose bytes all stand elsewhere too is marked as a whole (both by 128-bit digests), and only the others, with one of each kind of marked part, are cut further. Each start of a string
belongs to exactly one anchor, so a string never meets itself.

Strings of ``length`` bytes are removed. Those of ``least`` bytes tell which passages, as runs of whole words, stand in another place too
although they may be shorter than what is removed.

Defined cases: a null or empty text has no bytes; texts below ``length`` bytes keep all; rows that repeat, ids included, remove each
other; null ids are ids; no rows give none; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, tidy, written

SEED = 32
#: Distinct regions of one anchor that a suffix array takes; those of larger groups are cut into parts of so many starts, one width after the other.
HOT = 1500
WIDTHS = (64, 16, 4, 1)
#: Starts of one part ahead of the suffix arrays.
PART = 32
#: Bytes that one suffix array covers, but for its last group.
CHUNK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE), np.full(n, np.uint64(inverse))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def window_hashes(b: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit hash of each w-byte string of b."""
    if not _POWERS or len(_POWERS[0]) <= len(b):
        _POWERS[:] = _powers(max(1 << 17, 2 * len(b)))
    up, down = _POWERS
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return _mix((total[w:] - total[:-w]) * down[: len(b) - w + 1])


def anchors(b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, number of starts, place of the anchor behind the first start) for each run of strings that choose one anchor."""
    # Positions take the low 28 bits of the sort key; equal strings must compare alike, so all texts drop those bits there. Groups go by the whole hash.
    h = window_hashes(b, SEED)
    at = sliding_argmin(h >> np.uint64(28) << np.uint64(28), least - SEED + 1)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[cut]], cut, np.diff(np.concatenate([cut, [len(at)]])), at[cut] - cut


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of each w consecutive values; their low 28 bits are free, for texts below 256 MB."""
    if len(h) >= 1 << 28:
        raise ValueError("texts of 256 MB and more are not supported")
    n = len(h)
    key = h | np.arange(n, dtype=np.uint64)
    k = np.concatenate([key, np.full(-n % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    back = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & np.uint64((1 << 28) - 1)).astype(np.int64)


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of key's values (0 and above) in order, equal ones by place, and these values; in one sort of single words where both fit into them."""
    bits = len(key).bit_length()
    if int(key.max()) < 1 << 63 - bits:
        packed = np.sort(key << bits | np.arange(len(key)))
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of key's values in order, and the number of each place's value among the distinct ones."""
    order, ranked = _ordered(key)
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
    return order, name


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s (values above 0) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n % 3 == 1 an empty suffix closes the ones
    both = np.concatenate([one, two])
    top = int(t.max()) + 1
    if top**3 < 1 << 63 - n.bit_length():
        order, name = _named((t[both] * top + t[both + 1]) * top + t[both + 2])
    else:
        _, pair = _named(t[both] * top + t[both + 1])
        order, name = _named(pair * top + t[both + 2])
    if name.max() + 1 < len(both):
        order = suffix_array(name + 1)
    sa12 = both[order]
    rank = np.zeros(n + 5, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    zero = np.arange(0, n, 3)
    wide = len(both) + 2
    key0 = t[zero] * wide + rank[zero + 1]
    by, key0 = _ordered(key0)
    zero = zero[by]
    ones, twos = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    less = np.searchsorted(t[ones] * wide + rank[ones + 1], key0)
    _, pair = _named(np.concatenate([t[zero] * top + t[zero + 1], t[twos] * top + t[twos + 1]]))
    less += np.searchsorted(pair[len(zero) :] * wide + rank[twos + 2], pair[: len(zero)] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    spot = np.arange(len(zero)) + less
    free = np.ones(n, bool)
    free[spot] = False
    out[spot] = zero
    out[free] = sa12
    return out


def repeated_starts(regions: list[bytes], starts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and region, which of its strings of that length also start anywhere else in the regions; ``starts``: how many starts count in a region."""
    sizes, counts = np.array([len(r) for r in regions]), np.array(starts)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 2
    s[first[1:] - 1] = 1  # ends of regions differ from all bytes
    order, out = suffix_array(s), []
    for length in lengths:
        valid = np.zeros(len(s), bool)
        for a, n, k in zip(first, sizes, counts):
            valid[a : a + max(0, min(k, n - length + 1))] = True
        sa = order[valid[order]]
        again = np.zeros(len(s), bool)
        if len(sa) > 1:
            view = np.lib.stride_tricks.sliding_window_view(raw, length)
            h = window_hashes(raw, length)
            near = np.flatnonzero(h[sa[1:]] == h[sa[:-1]])
            for lo in range(0, len(near), 20_000):
                k = near[lo : lo + 20_000]
                k = k[(view[sa[k]] == view[sa[k + 1]]).all(axis=1)]
                again[sa[k]] = again[sa[k + 1]] = True
        out.append([again[a : a + n] for a, n in zip(first, sizes)])
    return out


def candidates(group: list[tuple], least: int, length: int) -> list[tuple]:
    """Regions (h, ctx, m, n, spot, s) of one anchor as (h, ctx, m, starts, bytes, first start), cut down to the starts that can have an equal string.

    Equal strings start equally far from their anchors, so they hold the common bytes of one part of starts, and another region holds these at the same distance.
    """
    width = max(1, min(PART, least // 2))
    held: dict[tuple, list[int]] = {}
    for i, (_, _, _, n, spot, s) in enumerate(group):
        for j in range((spot - min(n, len(s) - least + 1) + 1) // width, spot // width + 1):
            last = spot - width * j
            held.setdefault((j, xxhash.xxh3_64_intdigest(s[last : last - width + 1 + least])), []).append(i)
    near: dict[int, tuple[int, int]] = {}
    for (j, _), found in held.items():
        if len(found) > 1:
            for i in found:
                lo, hi = near.get(i, (j, j))
                near[i] = min(lo, j), max(hi, j)
    out = []
    for i, (lo, hi) in near.items():
        h, ctx, m, n, spot, s = group[i]
        a, e = max(0, spot - width * (hi + 1) + 1), min(n, len(s) - least + 1, spot - width * lo + 1)
        out.append((h, ctx, m, e - a, s[a : e - 1 + length], a))
    return out


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte intervals that the strings at the marked starts cover."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + length).tolist()))


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals as maximal runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, e in intervals:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((a, e))
    return out


def whole_words(b: bytes, a: int, e: int) -> int:
    """Words of b that lie whole between a and e."""
    found = b[a:e].split()
    n = len(found)
    if found:
        n -= a > 0 and not b[a - 1 : a].isspace() and not b[a : a + 1].isspace()
        n -= e < len(b) and not b[e : e + 1].isspace() and not b[e - 1 : e].isspace()
    return max(0, n)


def _parts(width: int):
    """For regions (h, ctx, spot, s) with ranges of starts (k length, s0, s1): the ranges cut by the starts' distance from the anchor into parts of ``width``, with
    a digest of the bytes that all strings of a part hold and one of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, ctx, spot, s, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                for r in ranges:
                    k, lo, hi = r["k"], r["s0"], r["s1"]
                    for j in range((spot - hi + 1) // width, (spot - lo) // width + 1):
                        first, last = spot - width * (j + 1) + 1, spot - width * j
                        a, b = max(lo, first), min(hi, last + 1)
                        core = xxhash.xxh3_128_digest(struct.pack("<qqq", h, k, j) + s[last : first + k])
                        hull = xxhash.xxh3_128_digest(struct.pack("<qqqq", h, k, a - spot, b - spot) + s[a : b - 1 + k])
                        out.append((core, hull, h, ctx, k, a, b))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["core", "hull", "h", "ctx", "k", "s0", "s1"])

    return run


def _hot_marks(cut: DataFrame, lengths: tuple[int, ...]) -> DataFrame | None:
    """(h, ctx, iv) of repeated strings in groups of very many regions (h, ctx, m, n, spot, s); None where there is no such group."""
    hot = written(cut.select("h", "ctx", "m", "n", "spot", "s"), "hot")
    if hot.isEmpty():
        return None
    size = F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")
    front = hot.select("h", "ctx", "n", F.octet_length("s").alias("z"), size).select("h", "ctx", "k", F.lit(0).alias("s0"), F.least(F.col("n"), F.col("z") - F.col("k") + 1).alias("s1")).where("s1 > 0")
    marks = None
    for width in (w for w in WIDTHS if w <= lengths[0] // 2):
        asked = front.groupBy("h", "ctx").agg(F.collect_list(F.struct("k", "s0", "s1")).alias("w"))  # a region's starts at most
        rows = hot.select("h", "ctx", "spot", "s").join(asked, ["h", "ctx"]).select("h", "ctx", "spot", "s", "w")
        rows = written(rows.mapInArrow(tidy(_parts(width)), "core binary, hull binary, h long, ctx long, k int, s0 int, s1 int"), "parts")
        part = F.struct("h", "ctx", "k", "s0", "s1")
        common = rows.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
        alike = written(rows.groupBy("hull").agg(F.count("*").alias("c"), F.min(part).alias("one")).where("c > 1").select("hull", "one"), "alike")
        judged = rows.join(common, "core", "left_semi").join(alike.select("hull", F.lit(True).alias("same")), "hull", "left")
        judged = written(judged.select("h", "ctx", "k", "s0", "s1", "same"), "judged")
        dropped(rows)
        own = judged.where("same").select("h", "ctx", "k", "s0", "s1")
        marks = own if marks is None else marks.unionByName(own)
        front = judged.where("same IS NULL").select("h", "ctx", "k", "s0", "s1")
        if front.isEmpty():
            break
        # One of each kind of marked parts goes on, as others may share some of its strings.
        front = front.unionByName(alike.select("one.*"))
    # Regions that stand elsewhere as a whole are marked already.
    marks = marks.join(hot.where("m = 1").select("h", "ctx"), ["h", "ctx"], "left_semi")
    return marks.groupBy("h", "ctx").agg(F.collect_list(F.struct(F.col("s0").alias("a"), (F.col("s1") - 1 + F.col("k")).alias("e"), "k")).alias("iv"))


def deduplicate(docs: DataFrame, length: int = 400, least: int = 300, words: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (runs of more than ``words`` whole words, all of whose strings of ``least`` bytes
    stand elsewhere too), repeats_passage (whether there is one); with keep_text also kept (the remaining bytes)."""
    least = min(least, length)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    long_ = keyed.where(F.octet_length("b") >= least).withColumn("th", F.xxhash64("b"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                buf = text.as_buffer()
                h, lo, n, spot = anchors(np.frombuffer(buf, np.uint8), least)
                view = memoryview(buf)
                size = np.minimum(n + length - 1, len(view) - lo)
                ctx = [xxhash.xxh3_64_intdigest(view[a : a + m], seed=k) for a, m, k in zip(lo.tolist(), size.tolist(), n.tolist())]
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array([id_] * k, pa.int64()), pa.array([th] * k, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(spot.astype(np.int32))], names=["h", "ctx", "id", "th", "lo", "n", "size", "spot"])

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in find(batches):
            held.append(x)
            if len(held) >= 256:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    records = written(long_.mapInArrow(tidy(batched), "h long, ctx long, id long, th long, lo int, n int, size int, spot int"), "anchors")
    kinds = written(records.groupBy("h", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "lo", "n", "size", "spot")).alias("r")), "regions")
    groups = kinds.groupBy("h").agg(F.sum("m").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("h", "kinds")
    shared = written(kinds.join(groups, "h").select("h", "ctx", "m", "r", "kinds"), "shared")
    dropped(kinds)
    # Intervals carry their string's length: all strings of a region that stands elsewhere as a whole.
    span = lambda a, e, k: F.struct(a.cast("int").alias("a"), e.cast("int").alias("e"), F.lit(k).alias("k"))
    longest = F.least(F.col("r.n"), F.col("r.size") - length + 1)
    both = F.array(span(F.lit(0), F.col("r.n") + least - 1, least), F.when(longest > 0, span(F.lit(0), longest + length - 1, length)))
    whole = shared.where("m > 1").select("h", "ctx", F.filter(both, lambda x: x.isNotNull()).alias("iv"))
    # One copy of each distinct region of groups with several: its bytes come from the document that it was first seen in.
    wanted = shared.where("kinds > 1").groupBy("r.id", "r.th").agg(F.collect_list(F.struct("h", "ctx", "m", "kinds", F.col("r.lo").alias("lo"), F.col("r.n").alias("n"), F.col("r.size").alias("size"), F.col("r.spot").alias("spot"))).alias("w"))
    once = long_.join(wanted, long_["id"].eqNullSafe(wanted["id"]) & (long_["th"] == wanted["th"])).select(long_["id"], long_["th"], "b", "w").dropDuplicates(["id", "th"])
    region = F.explode("w").alias("x")
    cut = written(once.select("b", region).select("x.h", "x.ctx", "x.m", "x.kinds", "x.n", "x.spot", F.substring(F.col("b"), F.col("x.lo") + 1, F.col("x.size")).alias("s")), "bytes")
    lengths = (least, length) if least < length else (length,)
    marks_type = pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            marks = repeated_starts([r[4] for r in rows], [r[3] for r in rows], lengths)
            out = []
            for k, (h, ctx, m, _, _, first) in enumerate(rows):
                own = [{"a": first + a, "e": first + e, "k": n} for n, mark in zip(lengths, marks) for a, e in runs(mark[k], n)] if m == 1 else []
                if own:
                    out.append((h, ctx, own))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], marks_type)], names=["h", "ctx", "iv"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    rows += (found := candidates(group, least, length))
                    group, size = [], size + sum(len(r[4]) for r in found)
                    if size > CHUNK:
                        yield settle()
                        rows, size = [], 0
                group.append(row)
        rows += candidates(group, least, length)
        if rows:
            yield settle()

    marks_schema = "h long, ctx long, iv array<struct<a:int,e:int,k:int>>"
    some = cut.where(F.col("kinds") <= HOT).select("h", "ctx", "m", "n", "spot", "s").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(sort), marks_schema)

    many = _hot_marks(cut.where(F.col("kinds") > HOT), lengths)
    marks = whole.unionByName(some) if many is None else whole.unionByName(some).unionByName(many)
    spans = records.join(marks, ["h", "ctx"]).select("id", "th", "lo", F.explode("iv").alias("x")).select("id", "th", "x.k", (F.col("lo") + F.col("x.a")).alias("a"), (F.col("lo") + F.col("x.e")).alias("e"))
    per_doc = spans.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("k", "a", "e"))).alias("iv"))
    everything = keyed.withColumn("th", F.xxhash64("b"))
    joined = everything.join(per_doc, (everything["id"].eqNullSafe(per_doc["id"])) & (everything["th"] == per_doc["th"]), "left").select(everything["id"], "b", F.col("iv.k").alias("k"), F.col("iv.a").alias("a"), F.col("iv.e").alias("e"))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "repeats_passage"] + ["kept"] * keep_text
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, repeats_passage boolean" + ", kept binary" * keep_text
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, *iv in zip(*(c.to_pylist() for c in batch.columns[1:])):
                marked = list(zip(*iv)) if iv[0] else []
                gone = merged([x[1:] for x in marked if x[0] == length])
                told = merged([x[1:] for x in marked if x[0] == least])
                kept, end = [], 0
                for a, e in gone:
                    kept.append(b[end:a])
                    end = e
                kept = b"".join(kept) + b[end:]
                passages = sum(whole_words(b, a, e) > words for a, e in told)
                out.append((len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), passages, passages > 0, kept))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in list(zip(cols, types))[: 6 + keep_text])], names=names)

    return joined.mapInArrow(tidy(remove), schema).withColumnRenamed("id", id_col)
