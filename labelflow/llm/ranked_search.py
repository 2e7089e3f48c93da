"""Ranked lexical search over document FP-trees.

1. Items give their distinct terms with repeats; items are taken in blocks whose
   distinct terms stay below ``BLOCK_TERMS``, so what is broadcast is bounded.
2. One pass over the texts gives each document its number of terms and its
   vector, restricted to the terms of the block's items.  N, L and the document
   frequencies are sums over these rows.
3. Each task orders its vectors by falling document frequency and inserts them
   into tries of at most ``TREE_POSTINGS`` postings, so documents share paths.
   A node is a term and the documents below it (an interval of the documents in
   path order), with their largest tf of the term and their smallest m.
4. For an item only nodes of its terms count.  What a node adds at most follows
   from its tf maximum and m minimum; the sum along a path bounds its documents,
   the largest such sum below a node bounds the subtree.  A depth-first walk
   skips every subtree whose bound is under the item's k-th best score so far
   (kept over all tries of a task) and scores the remaining documents exactly.
5. The tasks' best are ranked per item; each task sends k rows an item at most.

Scores are 64-bit integers; a term's weight is floor(1000 ln((2N+2)/(2df+1))),
m is 75 + (25 n N) div L, a term adds w * ((10^9 tf) div (1000 tf + 12 m)), once
for each of its repeats in the item.  Equal scores go by ascending doc_id (null
first); rows with the same doc_id are documents of their own.

Null texts have no terms; documents without terms don't count in N; items
without terms, or whose terms no document holds, give no rows.  Items with the
same item_id are ranked one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, staged, text_buffer, text_chunks

TOP = 20
#: Distinct terms (per item) that are broadcast together.
BLOCK_TERMS = 1 << 18
#: Bounds of one trie; a task builds as many as its documents need.
TREE_POSTINGS, TREE_DOCS = 1 << 20, 1 << 14
CHUNK_BYTES = 4 << 20
#: Documents of the highest bounds that are scored before the walk.
SEED = 64
#: Documents that the walk gathers before it scores them together.
GATHER = 256

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _TERM[_a:_b] = True


def cut_terms(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms one after another, and the number of terms of each text."""
    raw, offsets = text_buffer(texts)
    inside = _TERM[raw]
    row = np.zeros(len(raw) + 1, bool)
    row[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | row[1:len(raw)]
    data = _LOW[raw[inside]]
    begin = np.flatnonzero(first[inside])
    before = np.searchsorted(np.flatnonzero(first), offsets)
    flat = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes()),
                                            pa.py_buffer(data.tobytes()))
    return flat, np.diff(before)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_no, term, n): distinct terms of each row of ``items`` (item_no, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                flat, counts = cut_terms(part.column(1))
                words = flat.dictionary_encode()
                width = max(len(words.dictionary), 1)
                key, n = np.unique(np.repeat(np.arange(len(part)), counts) * width + words.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key // width)),
                                                  words.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.array(n.astype(np.int64))],
                                                 ["item_no", "term", "n"])

    return map_arrow(items, run, "item_no long, term string, n long")


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: the number of all their
    terms, the places of those in ``vocabulary`` and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        width = max(len(known), 1)
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                flat, counts = cut_terms(part.column(1))
                place = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(part)), counts)[place >= 0]
                key, tf = np.unique(row * width + place[place >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(key // width, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % width, tf)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(counts > 0))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """A trie of documents' vectors.  ``rank``: places of the terms by falling
    document frequency, ``start``: where each document's postings begin."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, rank: np.ndarray, tf: np.ndarray, start: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), np.diff(start))
        order = np.lexsort((rank, doc))
        rank, tf = rank[order], tf[order]
        big = rank.astype(">u4")
        keys = [big[a:b].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        by_path = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        size = np.diff(start)[by_path]
        self.start = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(start[by_path] - self.start[:-1], size) + np.arange(self.start[-1])
        self.rank, tf, self.ids, m = rank[place], tf[place], ids[by_path], m[by_path]
        self.ratio = _ratio(tf, np.repeat(m, size))
        self._nodes(tf, m, size)

    def _shared(self, size: np.ndarray) -> np.ndarray:
        """How many terms a document's path shares with the one before it."""
        out = np.zeros(len(size), np.int64)
        rank, start = self.rank, self.start
        for i in range(1, len(size)):
            k = min(size[i - 1], size[i])
            differ = rank[start[i - 1]:start[i - 1] + k] != rank[start[i]:start[i] + k]
            at = int(differ.argmax()) if k else 0
            out[i] = at if k and differ[at] else k
        return out

    def _nodes(self, tf: np.ndarray, m: np.ndarray, size: np.ndarray) -> None:
        shared = self._shared(size)
        found = []
        docs = np.arange(len(size))
        depth = 0
        while len(docs := docs[size[docs] > depth]):
            at = self.start[docs] + depth
            first = np.flatnonzero(shared[docs] <= depth)
            low = docs[first]
            high = docs[np.append(first[1:], len(docs)) - 1] + 1
            top = np.maximum.reduceat(tf[at], first)
            least = np.minimum.reduceat(m[docs], first)
            found.append((self.rank[at[first]], low, high, _ratio(top, least)))
            depth += 1
        term, low, high, ratio = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((low, term))
        self.term, self.low, self.high, self.bound = term[order], low[order], high[order], ratio[order]

    def search(self, ranks: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: "Best") -> None:
        """Add the item's best documents to ``best``; ``dense`` holds its weights by rank."""
        begin, end = np.searchsorted(self.term, ranks), np.searchsorted(self.term, ranks, "right")
        size = end - begin
        if not size.any():
            return
        node = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        low, high = self.low[node], self.high[node]
        adds = np.repeat(weights, size) * self.bound[node]
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, low, adds)
        np.subtract.at(step, high, adds)
        path = np.cumsum(step)[:-1]         # no document scores more than its path
        seed = np.argpartition(path, -SEED)[-SEED:] if len(path) > SEED else np.arange(len(path))
        seed = seed[path[seed] >= best.least]
        best.add(self._scores(seed, dense), self.ids[seed])
        done = np.zeros(len(path), bool)
        done[seed] = True
        ends = np.empty(2 * len(low), np.int64)
        ends[::2], ends[1::2] = low, np.minimum(high, len(path) - 1)
        bound = np.maximum.reduceat(path, ends)[::2]    # of the subtree; the last document apart
        bound = np.where(high == len(path), np.maximum(bound, path[-1]), bound)
        open_ = np.flatnonzero(bound >= best.least)
        open_ = open_[np.lexsort((-high[open_], low[open_]))]
        for lo, hi in self._walk(low[open_].tolist(), high[open_].tolist(), bound[open_].tolist(), best):
            docs = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
            docs = docs[(path[docs] >= best.least) & ~done[docs]]
            best.add(self._scores(docs, dense), self.ids[docs])

    @staticmethod
    def _walk(low: list[int], high: list[int], bound: list[int], best: "Best") -> Iterator[tuple[list[int], list[int]]]:
        """Intervals of documents in depth-first order, without the subtrees whose
        bound is under the k-th best score when the walk comes to them."""
        lo, hi, gathered, at, until = [], [], 0, 0, 0
        for a, b, most in zip(low, high, bound):
            if a < at:
                continue            # inside a subtree that was skipped
            if min(a, until) > at:  # documents that end above this node
                lo.append(at)
                hi.append(min(a, until))
                gathered += hi[-1] - at
            at = a if most >= best.least else b
            until = max(until, b)
            if gathered >= GATHER:
                yield lo, hi
                lo, hi, gathered = [], [], 0
        if until > at:
            lo.append(at)
            hi.append(until)
        if lo:
            yield lo, hi

    def _scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        size = self.start[docs + 1] - self.start[docs]
        if not len(docs):
            return np.zeros(0, np.int64)
        place = np.repeat(self.start[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.add.reduceat(dense[self.rank[place]] * self.ratio[place], np.cumsum(size) - size)


def _ratio(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Best:
    """The k best (score, id) so far, ids ascending where scores are equal."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


#: Stands for a null doc_id inside a task: it sorts first.
_NULL = np.iinfo(np.int64).min


def _search_vectors(vectors: DataFrame, rank: np.ndarray, queries: list, docs: int, terms: int, k: int) -> DataFrame:
    """(item_no, doc_id, score): at most k rows of each item from every task."""
    shared = vectors.sparkSession.sparkContext.broadcast((rank, queries))

    def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[Tree]:
        parts, postings, rows = [], 0, 0

        def build() -> Tree:
            t = pa.Table.from_batches(parts).combine_chunks()
            size = np.asarray(pc.list_value_length(t["terms"])).astype(np.int64)
            m = 75 + 25 * np.asarray(t["n"]) * docs // terms
            place, tf = (np.asarray(pc.list_flatten(t[c])) for c in ("terms", "tfs"))
            return Tree(np.asarray(pc.fill_null(t["doc_id"], _NULL)), m, rank[place], tf.astype(np.int64), np.concatenate([[0], np.cumsum(size)]))

        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
            at, sizes = 0, np.asarray(pc.list_value_length(b.column(2)))
            for i, n in enumerate(sizes.tolist()):
                if rows and (postings + n > TREE_POSTINGS or rows >= TREE_DOCS):
                    parts.append(b.slice(at, i - at))
                    yield build()
                    parts, postings, rows, at = [], 0, 0, i
                postings, rows = postings + n, rows + 1
            parts.append(b.slice(at))
        if rows:
            yield build()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, queries = shared.value
        best = [Best(k) for _ in queries]
        dense = np.zeros(len(rank), np.int64)
        for tree in trees(batches, rank):
            for (_, ranks, weights), b in zip(queries, best):
                dense[ranks] = weights
                tree.search(ranks, weights, dense, b)
                dense[ranks] = 0
        for (no, _, _), b in zip(queries, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), no)), pa.array(b.ids, mask=b.ids == _NULL), pa.array(b.scores)],
                                                 ["item_no", "doc_id", "score"])

    return map_arrow(vectors, run, "item_no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    items = staged(items.select("item_id", "text").withColumn("item_no", F.monotonically_increasing_id()), "search-items")
    terms = staged(item_terms(items.select("item_no", "text")), "search-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    found = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block).toArrow() if blocks > 1 else terms.toArrow()
        part = _search_block(docs, rows, k)
        found = part if found is None else found.union(part)
    if found is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(items.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    words = rows["term"].combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    vocabulary = words.dictionary.to_pylist()
    vectors = staged(term_vectors(docs, vocabulary), "search-vectors")
    total = vectors.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[np.asarray(held["term"])] = np.asarray(held["count"])
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    no, place, n = np.asarray(rows["item_no"]), words.indices.to_numpy().astype(np.int64), np.asarray(rows["n"])
    order = np.lexsort((rank[place], no))
    order = order[(df[place] > 0)[order] & (weight[place] > 0)[order]]
    no, place, n = no[order], place[order], n[order]
    cut = np.flatnonzero(np.diff(no, prepend=no[:1] - 1)) if len(no) else np.zeros(0, np.int64)
    queries = [(int(no[a]), rank[place[a:b]], weight[place[a:b]] * n[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(no)])]
    return _search_vectors(vectors, rank, queries, total["N"], total["L"], k)
