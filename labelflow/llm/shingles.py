"""Word shingles of whole texts as 64-bit hashes, computed with numpy on the
UTF-8 bytes of an Arrow batch.

A word hash is a polynomial over random byte values; a shingle hash mixes the
hashes of its words.  Two different shingles of one pair of documents collide
with probability below 1e-12, whatever the size of the corpus, because hashes
are only ever compared within a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from labelflow.llm.common import mix64, odd_numbers, text_buffer

SEPARATORS = (0x20, *range(0x09, 0x0E))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64, out=p))
    return out[0], out[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-separators, A-Z lower-cased) and the
    number of words of each row."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    is_word = np.ones(256, bool)
    is_word[list(SEPARATORS)] = False
    value = odd_numbers(256, 11)
    value[65:91] = value[97:123]
    word = is_word[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_of_rows = offsets[:-1][offsets[:-1] < n]
    first[starts_of_rows] = word[starts_of_rows]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.multiply(value[raw], power, out=power)
    np.cumsum(power, out=run[1:])
    h = mix64((run[end] - run[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _BASE)
    per_row = np.diff(np.searchsorted(begin, offsets))
    return h, per_row


def shingle_sets(arr: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct shingle hashes: ``size`` consecutive
    words, the whole sequence if there are fewer, none without words."""
    h, per_row = word_hashes(*text_buffer(arr))
    mult = odd_numbers(size, 23)
    total = np.zeros(len(h), np.uint64)
    for j in range(size):
        if j < len(h):
            total[:len(h) - j] += h[j:] * mult[j]
    total = mix64(total + np.uint64(size))
    out, at = [], 0
    for n in per_row:
        if n >= size:
            out.append(np.unique(total[at:at + n - size + 1]))
        elif n:
            short = (h[at:at + n] * mult[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
            out.append(mix64(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
