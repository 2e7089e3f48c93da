"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

Every token of a rank file becomes a piece (its bytes mapped to printable
characters) scored by its negative rank; normalisation is the identity, so
sentencepiece merges the same pair first as the ranks do.  Texts are cut by the
pre-token pattern; a pre-token that is itself a token keeps its rank, every
other one is encoded by the model.  Ids decode by the inverse mapping.

Null texts are empty.  Rows count one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, text_chunks

#: Distinct pre-tokens of a generation; a task remembers two (about 60 MB).
CACHE_ENTRIES = 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no
    space, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def model_bytes(vocab: list[bytes]) -> bytes:
    """A sentencepiece model file: pieces in order of rank, then the unknown piece."""
    chars = byte_characters()
    pieces = [("".join(chars[b] for b in token), -float(rank), 1) for rank, token in enumerate(vocab)]
    body = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
                    for p, score, kind in [*pieces, ("<unk>", 0.0, 2)])
    trainer = _number(3, 2) + _number(4, len(vocab) + 1) + _number(40, len(vocab)) + b"".join(_number(i, -1) for i in (41, 42, 43))
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _message(2, trainer) + _message(3, normalizer)


@dataclass
class ByteBpe:
    """Vocabulary in order of rank and the pre-token pattern."""

    vocab: list[bytes]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> "ByteBpe":
        """From a rank file: lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        return cls([ranks[i] for i in range(len(ranks))], pattern)

    @cached_property
    def model(self) -> bytes:
        return model_bytes(self.vocab)


class Encoder:
    """Encodes and decodes inside a task."""

    def __init__(self, bpe: ByteBpe, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(bpe.pattern).findall
        self.vocab = bpe.vocab
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(bpe.vocab)}
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        rest = []
        for t in tokens:
            raw = t.encode()
            if raw in self.whole:
                self.known[t] = self.whole[raw]
            else:
                rest.append((t, raw.decode("latin-1").translate(self.chars)))
        if rest:
            for (t, _), ids in zip(rest, self.processor.encode([m for _, m in rest], num_threads=1)):
                self.known[t] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        tokens = set().union(*split)
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [t for t in tokens if t not in known]
        known.update((t, older[t]) for t in new if t in older)
        self._learn([t for t in new if t not in known])
        return [b"".join([known[t] for t in s]) for s in split]

    def decode(self, rows: list[bytes | None]) -> list[bytes]:
        vocab = self.vocab
        return [b"".join([vocab[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]) for ids in rows]


def _run(df: DataFrame, bpe: ByteBpe, source: str, columns: dict[str, str], make, keep: list[str] = ()) -> DataFrame:
    """The ids of ``df``, its columns ``keep`` and the binary columns that
    ``make`` gives for a list of sources."""
    shared = df.sparkSession.sparkContext.broadcast((bpe.vocab, bpe.pattern, bpe.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pattern, model = shared.value
        enc = Encoder(ByteBpe(vocab, pattern), model)   # of this task, freed with it
        for b in batches:
            for lo, hi in text_chunks(b, "_source"):
                part = b.slice(lo, hi - lo)
                out = [pa.array(x, pa.binary()) for x in make(enc, part.column(1).to_pylist())]
                kept = [part.column(2 + i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([part.column(0), *kept, *out], names)

    rows = df.select("doc_id", F.col(source).alias("_source"), *keep)
    first, *rest = (f"{k} {v}" for k, v in columns.items())
    names = ["doc_id", *keep, *list(columns)[1:]]
    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join([first, *(f"{k} {kinds[k]}" for k in keep), *rest]))


def encode(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    return _run(docs, bpe, "text", {"doc_id": "long", "ids": "binary"}, lambda e, x: (e.encode(x),))


def decode(rows: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, decoded): the bytes of the ids."""
    return _run(rows, bpe, "ids", {"doc_id": "long", "decoded": "binary"}, lambda e, x: (e.decode(x),))


def round_trip(docs: DataFrame, bpe: ByteBpe, keep: list[str] = ()) -> DataFrame:
    """(doc_id, keep ..., ids, decoded): encode, then decode the ids, in one pass."""
    def both(enc: Encoder, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        ids = enc.encode(texts)
        return ids, enc.decode(ids)

    return _run(docs, bpe, "text", {"doc_id": "long", "ids": "binary", "decoded": "binary"}, both, keep)
