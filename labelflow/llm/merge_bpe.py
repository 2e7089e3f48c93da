"""BPE encoding by a priority queue of merge ranks, and decoding.

A pre-token's symbols stand in a doubly linked list.  A heap holds the possible
merges by (rank, place); a popped entry whose symbols have changed since is
stale and skipped; a merge links its neighbours and pushes the two new pairs.
Normalisation, pre-tokens, byte characters and the word end are read from the
tokenizer file.  Each distinct space-separated piece is merged once in a task
and remembered; ids decode by joining the vocabulary strings.

Null texts are empty and give no ids and an empty string.  Rows count one by
one, repeated ones too.  Extra columns are ignored.  Texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.byte_bpe import byte_characters
from labelflow.llm.common import map_arrow, text_chunks
from labelflow.llm.word_tokens import WordTokens, check_splits_at_space

#: Bytes of text that are cut into pieces together.
CHUNK_BYTES = 2 << 20


class MergeQueue:
    """Merges of a vocabulary over lists of symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.rule[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def merge(self, symbols: list[int]) -> list[int]:
        n, rule = len(symbols), self.rule
        if n < 2:
            return symbols
        symbols = [*symbols, -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        queue = []
        for i in range(n - 1):
            found = rule.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue    # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rule.get((new, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], new, symbols[k]))
            h = before[i]
            if h >= 0:
                found = rule.get((symbols[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbols[h], new))
        return [s for s in symbols if s >= 0]


class MergeTokens(WordTokens):
    """Cuts texts into pieces as its base class does; pieces are encoded here."""

    def __init__(self, spec: bytes):
        parsed = json.loads(spec)
        check_splits_at_space(parsed)
        model = parsed["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("not a plain BPE model")
        vocab: dict[str, int] = model["vocab"]
        self.queue = MergeQueue(vocab, model["merges"])
        self.lowers = "Lowercase" in json.dumps(parsed["normalizer"])
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the tokenizer's white space is Unicode's; regex would count U+001C to U+001F too
        self.pre_tokens = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.inner = [vocab.get(c, -1) for c in chars]
        self.last = [vocab.get(c + suffix, -1) for c in chars]
        added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.special = added
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.strings = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.strings[i] = token
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.space = np.arange(256, dtype=np.uint8)
        self.space[[9, 10, 13]] = 32
        self.low = self.space.copy()
        self.low[65:91] = self.space[97:123]

    def _word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.queue.merge([i for i in ids if i >= 0])

    def encode_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        for part in self.cut_special(piece) if self.cut_special and "<" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            if self.lowers:     # letter by letter: no rule for a final sigma
                part = part.lower() if part.isascii() else "".join([c.lower() for c in part])
            for word in self.pre_tokens(part):
                out += self._word(word)
        return out

    def _learn(self, plain: bool, pieces: list[str]) -> None:
        for p in pieces:
            ids = self._word(p) if plain else self.encode_piece(p)
            self.known[p] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


_ENCODERS: dict[str, MergeTokens] = {}


def merge_tokens(spec: bytes) -> MergeTokens:
    """The worker's encoder for a tokenizer file's content."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = MergeTokens(spec)
    return _ENCODERS[key]


def _spec(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(counts: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for n in counts.tolist():
        yield ids[at:at + n]
        at += n


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merge_tokens(spec.value)
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                rows = [x.tobytes() for x in _slices(*tokens.encode(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary")


def decode(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, decoded): the vocabulary strings of ``ids``, joined by spaces."""
    spec = _spec(rows, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merge_tokens(spec.value)
        for b in batches:
            for lo, hi in text_chunks(b, "ids", CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                text = [tokens.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["doc_id", "decoded"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows.select("doc_id", "ids"), run, f"doc_id {kind}, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded): encode, then decode the ids, in one pass."""
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merge_tokens(spec.value)
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                each = list(_slices(*tokens.encode(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in each], pa.binary()),
                                                  pa.array([tokens.decode(x) for x in each], pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip`` rows."""
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
