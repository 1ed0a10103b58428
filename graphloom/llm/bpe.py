"""Byte-level BPE by way of a sentencepiece BPE model that is serialised from a rank file.

Every byte is mapped to one printable character, so each vocabulary entry becomes a string of such
characters whose score is its negative rank; with identity normalisation sentencepiece then joins the pair of
lowest rank first, leftmost on ties, as byte-level BPE does. Pre-tokens are encoded one by one; ids are decoded
by the inverse table.

Defined cases: a null or empty text has no ids and the SHA-256 of nothing; repeated rows give repeated rows; a
table without rows gives none; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most chunks and most pre-tokens that a worker keeps with their ids; those seen first stay, and others are encoded each time.
CACHE = 500_000
#: A blank with white space on both sides: only there the cut before a blank could change pre-tokens.
_BLANKS = re.compile(r" (?:\s|\Z)")
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary of a rank file (base64 and rank per line) in order of rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protobuf field: int as varint, float as 32 bits, text and bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mapped(token: bytes) -> str:
    """Each byte as one character beyond ASCII and Latin-1; none is white space or a control character."""
    return token.decode("latin-1").translate(_TO_CHAR)


_TO_CHAR = {b: 0x4E00 + b for b in range(256)}


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece n+1 is vocabulary entry n with score -n; piece 0 is <unk>."""
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, mapped(token)) + _field(2, -float(rank))) for rank, token in enumerate(vocabulary)]
    trainer = _field(2, _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43)))
    normalizer = _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normalizer


class ByteBpe:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(vocabulary))
        self.split = regex.compile(pattern).findall
        self.token: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _ids(self, pretokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that the cache does not have; they enter it while there is room."""
        out, rest = {}, []
        for p in pretokens:
            i = self.rank.get(p.encode())
            if i is None:
                rest.append(p)
            else:
                out[p] = struct.pack("<I", i)
        if rest:
            made = self.model.encode([mapped(p.encode()) for p in rest], out_type=int, num_threads=1)
            flat = array("I", [i - 1 for ids in made for i in ids]).tobytes()
            at = 0
            for p, ids in zip(rest, made):
                out[p] = flat[at : (at := at + 4 * len(ids))]
        if len(self.token) < CACHE:
            self.token.update(out)
        return out

    def _exact(self, text: str) -> bytes:
        found = self.split(text)
        own = self._ids(set(found).difference(self.token))
        return b"".join(self.token[p] if p in self.token else own[p] for p in found)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _BLANKS.search(text) and _UNSAFE.search(text):
            return self._exact(text)
        first, *rest = text.split(" ")  # each later part stands for itself behind one blank
        head = self._exact(first)
        found = [*map(self.spaced.get, rest)]
        if None not in found:
            return head + b"".join(found)
        new = list({w for w, ids in zip(rest, found) if ids is None})
        cut = [self.split(" " + w) for w in new]
        own = self._ids({p for c in cut for p in c}.difference(self.token))
        kept = self.token.get
        made = {w: b"".join([kept(p) or own[p] for p in c]) for w, c in zip(new, cut)}
        if len(self.spaced) < CACHE:  # chunks with a line end hardly come again
            self.spaced.update((w, x) for w, x in made.items() if "\n" not in w)
        return head + b"".join([ids or made[w] for w, ids in zip(rest, found)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, array("I", ids)))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids, with keep_text the decoded text.

    ``vocabulary`` is a path that every worker can open (the file is part of the Python environment).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = bpe.encode(text)
                back = bpe.decode(raw)
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    ids.append(array("I", raw).tolist())
                if keep_text:
                    texts.append(back.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + [pa.array(ids, pa.list_(pa.int64()))] * keep_ids + [pa.array(texts, pa.string())] * keep_text, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
