"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays and traversed with numpy.

Null texts count as empty.  Every input row gives one output row, repeated ids
too; an id labelled twice takes the mean of its labels (a tie counts as good),
null labels are skipped.  Without labels, or with labels of one class only, all
rows score that share (0.5 without any).  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import held_out, map_arrow, text_buffer, text_chunks

#: Labelled rows the fit may use at most (a deterministic sample by id hash).
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.7

BYTE_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "newline": (10,), "stop": (46, 63), "comma": (44, 59, 58), "bang": (33,), "pipe": (124,),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126),
    "quote": (34, 39, 40, 41), "control": [*range(9), *range(14, 32), 127], "high": range(128, 256),
}
WORD_STATS = ("log_words", "mean_len", "long_share", "short_share", "distinct_share", "top_share", "adjacent_same",
              "line_distinct", "tail_symbol", "title_share")
FEATURES = ("log_bytes", "entropy", *BYTE_CLASSES, *WORD_STATS)


def byte_stats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, 2 + classes): log size, byte entropy and the share of each class."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    hist = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64)
    share = hist / np.maximum(sizes, 1)[:, None]
    ent = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    cols = [np.log1p(sizes), ent, *(share[:, list(c)].sum(1) for c in BYTE_CLASSES.values())]
    return np.stack(cols, 1)


def word_stats(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(WORD_STATS)
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    return (float(np.log1p(n)), float(lens.mean()), float((lens > 12).mean()), float((lens <= 2).mean()),
            len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
            len(set(lines)) / max(1, len(lines)),
            sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,") / n,
            sum(c for w, c in counts.items() if w[0].isupper()) / n)


def features(arr: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) statistics of whole texts."""
    raw, offsets = text_buffer(arr)
    words = np.array([word_stats(t or "") for t in arr.to_pylist()], np.float64).reshape(len(arr), len(WORD_STATS))
    return np.hstack([byte_stats(raw, offsets), words]).astype(np.float32)


@dataclass
class Trees:
    """All trees as complete binary heaps: (trees, nodes) arrays.  A row goes to
    child 2i + 2 if its feature exceeds the node's threshold, else 2i + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.arange(len(self.feature))
        node = np.zeros((len(x), len(t)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        z = self.base + self.leaf[t, node - (2 ** self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
              l2: float = 5.0, min_hessian: float = 3.0) -> Trees:
    """Boost logistic loss: per level one histogram of gradients and Hessians
    over (node, feature, bin), the best split of each node by gain."""
    n_nodes = 2 ** depth - 1
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, n_nodes), np.int64), np.zeros((0, n_nodes), np.float32), np.zeros((0, n_nodes + 1)),
                     base, depth)
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    edge = np.full((k, bins), np.inf, np.float32)
    for j, c in enumerate(cuts):
        edge[j, :len(c)] = c
    slot = binned + np.arange(k) * bins
    feat, thr = np.zeros((n_trees, n_nodes), np.int64), np.full((n_trees, n_nodes), np.inf, np.float32)
    leaf, z = np.zeros((n_trees, n_nodes + 1)), np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width = 2 ** d
            at = ((node - (width - 1))[:, None] * (k * bins) + slot).ravel()
            gh = [np.bincount(at, np.repeat(v, k), width * k * bins).reshape(width, k, bins).cumsum(2) for v in (g, h)]
            tot = [v[:, :1, -1:] for v in gh]
            right = [tot[i] - gh[i] for i in (0, 1)]
            gain = (gh[0] ** 2 / (gh[1] + l2) + right[0] ** 2 / (right[1] + l2) - tot[0] ** 2 / (tot[1] + l2))
            gain = np.where((gh[1] >= min_hessian) & (right[1] >= min_hessian) & np.isfinite(edge)[None], gain, 0)
            best = gain.reshape(width, -1).argmax(1)
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // bins, best % bins
            ids = np.arange(width) + width - 1
            feat[t, ids], thr[t, ids] = f, np.where(ok, edge[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feat[t, node]] > thr[t, node])
        at = node - n_nodes
        leaf[t] = -rate * np.bincount(at, g, n_nodes + 1) / (np.bincount(at, h, n_nodes + 1) + l2)
        z += leaf[t, at]
    return Trees(feat, thr, leaf, base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most about ``max_rows`` labelled rows that are
    not held out, chosen by a hash of the id.  The chosen (id, label) rows are
    bounded by ``max_rows``, so they are broadcast and no text is shuffled."""
    own = (labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null")
           .where(~held_out()).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    share = min(1.0, 0.95 * max_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS, **params) -> Trees:
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_chunks(b):
                part = b.slice(lo, hi - lo)
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float32()))],
                                                 ["doc_id", "y", "x"])

    rows = map_arrow(labelled_sample(docs, labels, label, max_rows), stats, "doc_id long, y int, x array<float>").toArrow()
    rows = rows.sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.asarray(rows["y"]).astype(np.float64), **params)


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, texts whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_chunks(b):
                part = b.slice(lo, hi - lo)
                s = model.score(features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns, no shuffle."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_chunks(b):
                part = b.slice(lo, hi - lo)
                keep = model.score(features(part.column(at))) >= threshold
                yield part.filter(pa.array(keep))

    return map_arrow(docs, run, schema)
