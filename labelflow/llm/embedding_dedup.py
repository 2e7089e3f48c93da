"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised; in each of L tables, m quantised random projections
floor((a.v + b) / w) form a bucket.  m follows from the number of different
vectors (so that unrelated ones seldom meet), L from the wanted recall at the
threshold.  Vectors that share a bucket are compared exactly, in double
precision; a pair counts in the first table in which it meets.

Equal vectors collapse to one first, with their number.  A bucket of more than
BLOCK vectors is compared in pairs of blocks, each a group of its own, so no
bucket is held in one task and none is capped.  Groups give link counts and a
spanning forest of their links, not pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link.  Rows with a null id are
dropped, repeated rows count once; an id that comes with different vectors has a
row for each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import components, map_arrow, mix64, odd_numbers, staged

COSINE = 0.95
WIDTH = 2.0
RECALL = 0.995
#: Unrelated vectors expected in a bucket.
STRAY = 0.25
BLOCK = 512
SEED = 20


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection puts two vectors together."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and number of tables for n different vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    m = max(2, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(far)))
    return m, math.ceil(math.log(1 - recall) / math.log(1 - near ** m))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _raw(v: list | None) -> bytes | None:
    if not v or None in v:
        return None
    x = np.array(v, "<f8")
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def _buckets(vectors: list[bytes], m: int, tables: int, width: float) -> np.ndarray:
    """(n, tables) bucket hashes."""
    x = _matrix(vectors)
    rng = np.random.default_rng([SEED, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], m * tables)), rng.uniform(0, width, m * tables)
    q = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, m)
    mult = odd_numbers(m, 31)
    return mix64((q * mult).sum(2, dtype=np.uint64) + np.uint64(x.shape[1])).view(np.int64)


def _links(group: np.ndarray, side: np.ndarray, table: np.ndarray, x: np.ndarray, b: np.ndarray,
           cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group that reach the cosine and did not meet in an
    earlier table.  Rows are sorted by group; side 0 or 1 rows of a pair of
    blocks meet the other side only, side -1 rows meet all."""
    us, vs = [], []
    d = 1
    rows = np.arange(len(group))
    while True:
        i = rows[:-d] if d < len(rows) else rows[:0]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        j = i + d
        ok = (side[i] < 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        if len(i):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[near], j[near]
            met = b[i] == b[j]
            first = met.argmax(1) == table[i]
            us.append(i[first])
            vs.append(j[first])
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_raw(v) for v in b.column(1).to_pylist()], pa.binary())],
                                             ["vec_id", "v"])

    rows = embeddings.where("vec_id is not null").select("vec_id", "embedding")
    vectors = staged(map_arrow(rows, keys, "vec_id long, v binary").distinct(), "vectors")
    reps = staged(vectors.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
                  .select("rep", "v", "n", F.octet_length("v").alias("size")), "different-vectors")
    m, tables = parameters(reps.count(), cosine, width, recall)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(3))
            for s in np.unique(sizes):
                part = b.filter(pa.array(sizes == s))
                h = _buckets(part.column(1).to_pylist(), m, tables, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(list(h), pa.list_(pa.int64()))],
                    ["rep", "v", "n", "buckets"])

    hashed = staged(map_arrow(reps, hashes, "rep long, v binary, n long, buckets array<long>"), "vector-buckets")
    posts = hashed.select("rep", F.posexplode("buckets").alias("t", "bucket"))
    sizes = posts.groupBy("t", "bucket").agg(F.count("*").alias("k")).where("k > 1")
    # a vector that shares a bucket goes there with its bucket numbers, once for each pair of blocks it is in
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    place = posts.join(sizes, ["t", "bucket"]).select("rep", "t", "bucket", blocks.alias("nb"))
    place = place.withColumn("i", F.expr("CAST(pmod(xxhash64(rep), nb) AS INT)"))
    tasks = F.expr("""transform(sequence(0, nb - 1), j -> struct(least(i, j) AS lo, greatest(i, j) AS hi,
                                IF(i = j, -1, IF(i < j, 0, 1)) AS side))""")
    place = place.select("rep", "t", "bucket", F.explode(tasks).alias("task")).select("rep", "t", "bucket", "task.*")
    group = F.xxhash64("t", "bucket", "lo", "hi")
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (place.join(hashed, "rep").select(group.alias("g"), "t", "bucket", "lo", "hi", "side", "rep", "n", "v", "buckets")
            .repartition(parts, "g").sortWithinPartitions("t", "bucket", "lo", "hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            key = _group_numbers(held)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut:
                yield _compare(held.slice(0, cut), cosine)
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield _compare(held, cosine)

    found = staged(map_arrow(rows, compare, "a long, b long, links long"), "vector-links")
    degree = (found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")))
    comp = components(found.where("b is not null").select("a", "b"))
    out = (vectors.join(reps.select("v", "rep", "n"), "v", "left")
           .join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _group_numbers(t: pa.Table) -> np.ndarray:
    """0, 1, 2, ... by group, for rows sorted by group."""
    if not len(t):
        return np.zeros(0, np.int64)
    cols = [np.asarray(t[c]) for c in ("t", "bucket", "lo", "hi")]
    new = np.zeros(len(t), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _compare(t: pa.Table, cosine: float, rows: int = 50_000) -> pa.RecordBatch:
    """Link counts (a, null, links) and forest edges (a, b, null) of whole groups."""
    key = _group_numbers(t)
    out_a, out_b, out_n = [], [], []
    at = 0
    while at < len(key):
        stop = min(at + rows, len(key))
        if stop < len(key):
            whole = int(np.searchsorted(key, key[stop]))
            stop = whole if whole > at else int(np.searchsorted(key, key[at], side="right"))
        p = t.slice(at, stop - at)
        raw = p["v"].to_pylist()
        size = np.array([len(v) for v in raw])
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            q = p.take(pa.array(own))
            rep, n = np.asarray(q["rep"]), np.asarray(q["n"])
            u, v = _links(key[at:stop][own], np.asarray(q["side"]), np.asarray(q["t"]), _matrix([raw[i] for i in own]),
                          np.array(q["buckets"].to_pylist(), np.int64), cosine)
            if not len(u):
                continue
            links = np.bincount(u, n[v], len(rep)) + np.bincount(v, n[u], len(rep))
            low = np.arange(len(rep))
            while True:
                now = low.copy()
                np.minimum.at(now, u, low[v])
                np.minimum.at(now, v, low[u])
                now = now[now]
                if (now == low).all():
                    break
                low = now
            some, move = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(rep)))
            out_a += [rep[some], rep[move]]
            out_b += [np.full(len(some), -1), rep[low[move]]]
            out_n += [links[some].astype(np.int64), np.zeros(len(move), np.int64)]
        at = stop
    a, b, n = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_n))
    edge = np.concatenate([np.repeat([False, True], [len(out_a[i]), len(out_a[i + 1])]) for i in range(0, len(out_a), 2)]) \
        if out_a else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~edge), pa.array(n, mask=edge)], ["a", "b", "links"])
