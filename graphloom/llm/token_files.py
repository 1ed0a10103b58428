"""Token ids in Parquet: list columns, delta-encoded, with bounded row groups and page indexes.

Documents are dealt by ranges of their id and sorted, encoded, and written one file for each range, so ids
ascend within files and from file to file. A row holds doc_id, file (number of its range), local_start (ids before it in
its file), n_tokens and tokens. Version-2 pages let Parquet store integers without a dictionary as deltas; the dictionary
is off for the token column's plain ids and row groups and pages are small, so a reader takes single
columns or single row groups (the column index holds each page's least and greatest doc_id).

Defined cases: a null or empty text holds the end id alone; repeated ids follow each other; no rows give no
files and no result; other columns are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path

#: Most chunks, and most pieces of chunks, that a worker keeps with their ids; those seen first stay, and others are encoded each time.
CACHE = 500_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
_MARKS = ".,!?;:"
_BLANKS = re.compile(r" (?:\s|\Z)")
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def _byte_chars() -> dict[int, str]:
    """The character that byte-level models have for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Encoder:
    """The tokenizers library behind a cache of blank-separated chunks.

    A cut before a blank never parts a pre-token unless white space stands on both sides of the blank;
    texts with such blanks go to the library whole. Pieces of letters are one pre-token each: where a tokenizer only cuts pre-tokens and
    maps bytes ahead of its model, the library's model gets them itself.
    """

    to_char = _byte_chars()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cut, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        self.direct = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.tokenizer.normalizer is None and all(t.special for t in added)
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _pieces(chunk: str) -> tuple[str, ...]:
        """A chunk behind its blank as pieces that no pre-token spans: letters, closing marks, single line ends; else itself."""
        core = chunk.rstrip(_MARKS)
        if core.isalpha():
            return (" " + chunk,) if core == chunk else (" " + core, chunk[len(core) :])
        out: list[str] = []
        for k, line in enumerate(chunk.split("\n")):
            core = line.rstrip(_MARKS)
            if not core.isalpha():
                return (" " + chunk,)
            if k:
                out.append("\n")
            out.append(core if k else " " + core)
            if core != line:
                out.append(line[len(core) :])
        return tuple(out)

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces."""
        out: dict[str, bytes] = {}
        rest = pieces
        if self.direct:
            rest, tokenize, to_char = [], self.model.tokenize, self.to_char
            for p in pieces:
                if (p[1:] if p[:1] == " " else p).isalpha():
                    out[p] = array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(to_char))]).tobytes()
                else:
                    rest.append(p)
        if rest:
            out.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks; pieces stay in the cache while there is room, and so do chunks without a line end, which may come again."""
        cut = {w: self._pieces(w) for w in chunks}
        own = self._encoded(list({p for x in cut.values() for p in x}.difference(self.piece)))
        if len(self.piece) < CACHE:
            self.piece.update(own)
        kept = self.piece.get
        made = {w: b"".join([kept(p) or own[p] for p in x]) for w, x in cut.items()}
        if len(self.cache) < CACHE:
            self.cache.update((w, x) for w, x in made.items() if "\n" not in w)
        return made

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _BLANKS.search(text) and _UNSAFE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        head = self.piece.get(first)
        if head is None:
            head = self._encoded([first])[first] if first else b""
            if len(self.piece) < CACHE and first.isalpha():
                self.piece[first] = head
        found = [*map(self.cache.get, rest)]
        if None in found:
            made = self._learn({w for w, ids in zip(rest, found) if ids is None})
            found = [ids or made[w] for w, ids in zip(rest, found)]
        return head + b"".join(found)


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Write the token files of ``docs`` at ``path``. ``files``: how many ranges, else one for each shuffle partition."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, file int, local_start long, n_tokens long, tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start, end = _encoder(tokenizer), TaskContext.get().partitionId(), 0, np.uint32(end_id).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # a list column's offsets are 32-bit, and memory stays bounded
                piece = batch.slice(lo, 256)
                raws = [encoder.encode(t) + end for t in piece.column(1).to_pylist()]
                sizes = np.array([len(r) // 4 for r in raws], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), "<i4")))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(raws), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes), tokens], names=[id_col, "file", "local_start", "n_tokens", "tokens"])
                start += int(offsets[-1])

    ranged = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(files, id_col).sortWithinPartitions(F.col(id_col), F.xxhash64(text_col), F.col(text_col))
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#tokens.list.element": "false",
        "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "maxRecordsPerFile": "0",
    }
    ranged.mapInArrow(run, schema).write.options(**options).parquet(path)


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document without its tokens: id, file, start (ids of all documents before it), n_tokens. Reads metadata columns only."""
    meta = spark.read.parquet(path).select(id_col, "file", "local_start", "n_tokens")
    # One row for each file: the running sum over all of them stays small and is sent to every task.
    sums = meta.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return meta.join(F.broadcast(base), "file").select(id_col, "file", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), all from the files."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, file int, local_start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(batch.column(3).values.to_numpy(zero_copy_only=False), "<u4"))
            n, crc = np.diff(at), [zlib.crc32(flat[a:e]) for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "file", "local_start", "n_tokens", "ids_crc32"])

    read = rows.select(id_col, "file", "local_start", "tokens").mapInArrow(run, schema)
    return read.join(F.broadcast(base), "file").select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read their digest back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col)
