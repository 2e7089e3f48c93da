"""Token ids of a tokenizer file whose texts split at white space, taken from
the library one distinct piece at a time.

The tokenizer collapses white space and drops it, and no token spans it, so a
text's ids are those of its space-separated pieces in order; a full stop or
comma that ends a piece after an ASCII letter is a token run of its own.  Each
distinct piece is encoded by the library once and remembered.  Tokenizers of
another kind are refused.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa

from labelflow.llm.common import text_buffer

#: Distinct pieces of a generation; a worker remembers two (about 140 MB).
CACHE_ENTRIES = 300_000
PIECES_PER_CALL = 4000
#: Lower-case Latin letters: the tokenizer takes a run of them as one pre-token
#: and does not change it.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes of text whose pieces are counted together.
CHUNK_BYTES = 8 << 20


def check_splits_at_space(spec: dict) -> None:
    """Refuse tokenizer files for which cutting at spaces could change ids."""
    normal = spec.get("normalizer") or {}
    steps = [s.get("type") for s in normal.get("normalizers", [normal])]
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    flags = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if not drops or flags or not set(steps) <= {"NFC", "Replace", "Lowercase"} or r"[^\s" not in (first.get("pattern") or {}).get("Regex", ""):
        raise ValueError("this tokenizer does not split at white space")


class WordTokens:
    """Encodes texts inside a task."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        check_splits_at_space(parsed)
        self.lowers = "Lowercase" in json.dumps(parsed["normalizer"])
        self.tokenizer = Tokenizer.from_str(spec.decode())
        # for pieces of plain letters: the same model without the steps that leave them as they are
        byte_level = parsed["pre_tokenizer"]["pretokenizers"][1:]
        parsed |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}}
        self.plain = Tokenizer.from_str(json.dumps(parsed))
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        # in a run of plain letters exactly the last token carries the word's end
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        self.is_end = None
        if suffix:
            self.is_end = np.zeros(max(parsed["model"]["vocab"].values()) + 1, bool)
            self.is_end[[i for t, i in parsed["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.space = np.arange(256, dtype=np.uint8)
        self.space[[9, 10, 13]] = 32
        self.low = self.space.copy()
        self.low[65:91] = self.space[97:123]

    def _learn(self, plain: bool, pieces: list[str]) -> None:
        """Encode pieces joined by spaces, some thousand at a time.  The word
        ends, or else the offsets of the library, tell where a piece's ids end."""
        tokenizer = self.plain if plain else self.tokenizer
        for at in range(0, len(pieces), PIECES_PER_CALL):
            part = pieces[at:at + PIECES_PER_CALL]
            if plain and self.is_end is not None:
                ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
                cut = [0, *((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()]
            else:
                e = tokenizer.encode(" ".join(part), add_special_tokens=False)
                ids = np.array(e.ids, np.int64)
                begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in part])])
                cut = (np.searchsorted(np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], begin) * 4).tolist()
            if len(cut) != len(part) + 1:
                raise ValueError("the tokenizer's word ends do not tell pieces apart")
            raw = ids.astype("<u4").tobytes()
            for p, lo, hi in zip(part, cut, cut[1:]):
                self.known[p] = raw[lo:hi]

    def pieces(self, values: list[str]) -> list[bytes]:
        """Ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        new = [v for v in values if v not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, self.older, new = {}, self.known, values
        known, older = self.known, self.older
        for v in new:
            if v in older:
                known[v] = older[v]
        new = [v for v in new if v not in known]
        plain = [v for v in new if _PLAIN.fullmatch(v)]
        self._learn(True, plain)
        if len(plain) < len(new):
            self._learn(False, [v for v in new if v not in known])
        return [known[v] for v in values]

    def _split(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Distinct pieces and their places; the number of pieces before each row.
        A full stop or comma between an ASCII letter and a piece's end is a piece."""
        raw, offsets = text_buffer(texts)
        # a special token is told apart by case, so texts with one keep theirs
        raw = (self.low if self.lowers and b"<|" not in raw.tobytes() else self.space)[raw]
        n = len(raw)
        gap = raw == 32
        row = np.zeros(n + 1, bool)
        row[offsets] = True
        after = np.ones(n, bool)  # a piece ends after this byte
        after[:-1] = gap[1:] | row[1:n]
        letter = ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90))
        stop = ((raw == 46) | (raw == 44)) & after
        stop[1:] &= letter[:-1]
        stop[:1] = False
        stop &= ~row[:n]
        first = stop | row[:n]
        first[1:] |= gap[:-1]
        keep = ~gap
        begin = np.flatnonzero(first[keep])
        data = raw[keep]
        first &= keep
        before = np.searchsorted(np.flatnonzero(first), offsets)
        flat = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes()),
                                                pa.py_buffer(data.tobytes()))
        return flat.dictionary_encode(), before

    def encode(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text (null: empty) and all ids one after another."""
        words, before = self._split(texts)
        found = self.pieces(words.dictionary.to_pylist())
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = words.indices.to_numpy().astype(np.int64)
        each = lens[index]
        run = np.concatenate([[0], np.cumsum(each)])
        counts = np.diff(run[before])
        if not ids:
            return counts, None
        store = np.frombuffer(b"".join(found), "<u4")
        start = np.cumsum(lens) - lens
        return counts, store[np.repeat(start[index] - run[:-1], each) + np.arange(run[-1])]


_TOKENIZERS: dict[str, WordTokens] = {}


def word_tokens(spec: bytes) -> WordTokens:
    """The worker's encoder for a tokenizer file's content."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokens(spec)
    return _TOKENIZERS[key]
