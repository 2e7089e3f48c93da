"""N-gram Jaccard self-join: size-aware heavy-light join.

Sets of word shingles with Jaccard similarity of at least ``percent`` / 100 are
linked.  Identical sets collapse to one representative first.  With elements in
one global order (elements of frequent shingles last), two sets of sizes a <= b
that overlap in c >= ceil(percent * b / 100) elements share at least one of
their first ``a - c + 1`` and two of their first ``a - c + 2`` elements:

* light sets (size up to the boundary) enumerate the 2-subsets of that prefix;
* heavy sets, and light ones near enough in size, post the prefix elements to
  inverted lists, which are scanned.

The boundary is the largest size up to which the subsets of a set cost less
than scanning its lists, with list lengths estimated from a count sketch of all shingles.

Lists are scanned without emitting all pairs of a group: each member of a list
is first compared with the list's smallest member; only members that are not in
one component after that are compared with one another, by pairs or, where a
whole group is cheaper than its lists, in blocks.  Every pair that could still
join two components is compared exactly, so components are exact.  Links are
then counted within components, block by block: every link counts, no pair of a
group is emitted.

Null texts and texts without words have an empty set and no links.  Repeated
rows (same id) count as one document; an id that comes with different texts has
one row for each distinct set, and its links join them.  Rows with a null id
are dropped.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import (components, filter_slot, id_filter, map_arrow, maybe_in, mix64, ship, staged,
                                  text_chunks)
from labelflow.llm.shingles import shingle_sets

WORDS = 5
PERCENT = 80
#: Slots of the count sketch that orders shingles, frequent ones last: one byte
#: each (4 MB), sent to every executor.  Any order gives the same result; a
#: good one only shortens the lists.
SLOTS = 1 << 22
SLOT_BLOCK = 1 << 15
#: Bytes of text that are shingled together (about 40 bytes of work arrays each).
CHUNK_BYTES = 2 << 20
#: Shingles a task gathers before it counts them.
PENDING = 1 << 20
#: Bits of the filter that tells keys of several documents (4 MB).
KEY_BITS = 1 << 25
#: Bits of a key by which keys are counted for that filter.
COUNTED_BITS = 40
#: Pairs (16 bytes each) up to which they are sent to the texts instead of
#: shuffling with them; counted before the choice.
MAX_SENT_PAIRS = 2_000_000
#: The same for the members of dense groups (about 60 bytes each).
MAX_SENT_MEMBERS = 500_000
#: Documents of a dense group compared in one task against as many others, and
#: bytes of their shingle hashes.
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Members of a list from which it is compared in blocks whatever it costs.
MAX_LIST = 1024
#: Groups in which the tasks' counts are added up first.
ADD_PARTS = 64


def overlap_needed(a, b, percent: int = PERCENT):
    """Smallest intersection with 100 * inter >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_len(n: int, subset: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + subset)


def _each_set(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
            part = b.slice(lo, hi - lo)
            yield part, shingle_sets(part.column(part.schema.get_field_index("text")), words)


def shingle_stats(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, float, dict[int, int]]:
    """One pass over all shingles: the log-scaled counts by slot, the expected
    length of the list of a prefix element, and shingles in total by set size
    (powers of two).  What a task sends and what the driver gets has a fixed size."""
    def run(batches):
        counts, sizes = np.zeros(SLOTS, np.uint16), np.zeros(64, np.int64)
        pending, waiting = [], 0

        def count() -> None:
            slot, n = np.unique((np.concatenate(pending) & np.uint64(SLOTS - 1)).astype(np.uint32), return_counts=True)
            counts[slot] = np.minimum(counts[slot] + n, 255)

        for _, sets in _each_set(batches, words):
            for s in sets:
                pending.append(s)
                waiting += len(s)
                sizes[int(len(s)).bit_length()] += len(s)
            if waiting > PENDING:
                count()
                pending, waiting = [], 0
        if pending:
            count()
        blocks = counts.astype(np.uint8).reshape(-1, SLOT_BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array([*(zlib.compress(blocks[i].tobytes(), 1) for i in used), sizes.tobytes()])],
            ["block", "counts"])

    def add(key, table, last):
        rows = [x.as_py() for x in table["counts"]]
        if key[0].as_py() < 0:
            data = sum(np.frombuffer(x, np.int64) for x in rows).tobytes()
        else:
            raw = [zlib.decompress(x) for x in rows]    # 8 bits a slot from the tasks, 64 after the first step
            n = sum(np.frombuffer(x, np.uint8 if len(x) == SLOT_BLOCK else np.int64).astype(np.int64) for x in raw)
            data = np.minimum(np.round(8 * np.log2(1 + n)), 255).astype(np.uint8).tobytes() if last else zlib.compress(n.tobytes(), 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([data], pa.binary())})

    # added up in two steps: a group gets the square root of the tasks' rows at most
    rows = map_arrow(docs.select("text"), run, "block long, counts binary").withColumn("part", F.spark_partition_id() % ADD_PARTS)
    part = rows.groupBy("block", "part").applyInArrow(lambda key, t: add(key, t, False), "block long, counts binary")
    found = part.groupBy("block").applyInArrow(lambda key, t: add(key, t, True), "block long, counts binary").toArrow()
    level, sizes = np.zeros(SLOTS, np.uint8), np.zeros(64, np.int64)
    for block, data in zip(found["block"].to_pylist(), found["counts"].to_pylist()):
        if block < 0:
            sizes = np.frombuffer(data, np.int64)
        else:
            level[block * SLOT_BLOCK:(block + 1) * SLOT_BLOCK] = np.frombuffer(data, np.uint8)
    total = int(sizes.sum())
    by_level = np.bincount(level, minlength=256)
    count = np.round(2 ** (np.arange(256) / 8) - 1)
    share = np.cumsum(by_level * count) / max(1, total)
    low = max(1, int(np.searchsorted(share, 0.2)))  # the rarest fifth of all shingles fills the prefixes
    mean = (by_level * count ** 2)[:low + 1].sum() / max(1.0, (by_level * count)[:low + 1].sum())
    return level, float(max(1.0, mean - total / SLOTS)), {i: int(n) for i, n in enumerate(sizes) if n}


def light_boundary(list_length: float, sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest set size up to which enumerating 2-subsets of the prefix costs no
    more than posting and scanning the prefix elements' lists."""
    top, best = 1 << max(sizes, default=1), 1
    for n in range(2, top + 1):
        p1, p2 = prefix_len(n, 1, percent), prefix_len(n, 2, percent)
        if p2 * (p2 - 1) / 2 > p1 * (1 + list_length):
            break
        best = n
    return best


def prefix_keys(s: np.ndarray, level: np.ndarray, boundary: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of one set: hashed 2-subsets and / or prefix elements."""
    n = len(s)
    if n == 0:
        return s
    s = s[np.argsort(level[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")]
    out = []
    if n <= boundary:
        p = s[:prefix_len(n, 2, percent)]
        i, j = np.triu_indices(len(p), 1)
        lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        out.append(mix64(lo * np.uint64(3) + mix64(hi)) | np.uint64(1))
    if n > boundary or 100 * n >= percent * (boundary + 1):
        out.append(s[:prefix_len(n, 1, percent)] & ~np.uint64(1))
    return np.concatenate(out)


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over
    the elements that occur more than once, some columns at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    col = rank[col]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, len(shared), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        m = np.zeros((n, min(columns, len(shared) - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


class JaccardJoin:
    """Runs the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.docs = docs.select("doc_id", "text").where("doc_id is not null")
        self.words, self.percent = words, percent
        self.level, self.list_length, self.sizes = shingle_stats(self.docs, words)
        self.boundary = light_boundary(self.list_length, self.sizes, percent)
        self._sets()

    def _sets(self) -> None:
        spark = self.docs.sparkSession
        level = spark.sparkContext.broadcast(self.level)
        words, boundary, percent = self.words, self.boundary, self.percent

        def run(batches):
            for b, sets in _each_set(batches, words):
                keys = [prefix_keys(s, level.value, boundary, percent).view(np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["doc_id", "n_shingles", "digest", "keys"])

        rows = map_arrow(self.docs, run, "doc_id long, n_shingles long, digest binary, keys array<long>")
        both = staged(rows, "shingle-keys")
        sets = both.select("doc_id", "n_shingles", "digest").distinct()
        reps = sets.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        self.members = staged(sets.join(reps, "digest", "left")
                              .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "set-members")
        posts = both.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
        # keys of one document only link nothing; most are, and go before the posts are shuffled:
        # their upper bits are enough to count them, lists are built from whole keys
        posts = posts.withColumn("upper", F.shiftrightunsigned("key", 64 - COUNTED_BITS))
        shared = posts.groupBy("upper").agg(F.count("*").alias("c")).where("c > 1").select("upper")
        bits = spark.sparkContext.broadcast(id_filter(shared, "upper", KEY_BITS))

        def among(batches):
            for b in batches:
                yield b.filter(pa.array(maybe_in(bits.value, np.asarray(b.column(3))))).select([0, 1, 2])

        posts = map_arrow(posts.select("key", "doc_id", "n", filter_slot("upper", KEY_BITS).alias("slot")), among,
                          "key long, doc_id long, n long")
        own = self.members.where("rep = doc_id").select("doc_id").distinct()
        posts = staged(posts.join(own, "doc_id"), "posts")
        lists = posts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        posts = staged(posts.join(lists, "key"), "inverted-lists")
        # the member whose lists are longest stands closest to the others
        central = posts.groupBy("doc_id").agg(F.sum("m").alias("weight"))
        posts = posts.join(central, "doc_id")
        pivot = posts.groupBy("key").agg(F.max(F.struct("weight", F.negative("doc_id").alias("d"), "n")).alias("top"))
        self.posts = staged(posts.join(pivot.select("key", F.negative("top.d").alias("pivot"), F.col("top.n").alias("pivot_n")),
                                       "key").select("key", "doc_id", "n", "pivot", "pivot_n"), "list-pivots")

    def _fits(self, a: str, b: str):
        """Sizes that can reach the similarity."""
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough.  Only texts of the
        documents in question are shingled again and shuffled."""
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        percent, sets = self.percent, self._sets_of(ids)
        small = pairs.count() <= MAX_SENT_PAIRS
        sent = F.broadcast if small else (lambda df: df)
        right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")).join(sent(pairs), "b")
        left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")).join(sent(pairs.select("a").distinct()), "a")

        def check(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    u, v = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        wide = right.join(left, "a").select("a", "b", "sa", "sb")
        return staged(map_arrow(wide, check, "a long, b long").distinct(), "links")

    def links(self) -> DataFrame:
        """Verified links (a, b) between representatives of different sets.  All
        links that a list's pivot has, and all links between members that those leave in different components."""
        first = staged(self.posts.where("doc_id <> pivot").where(self._fits("n", "pivot_n"))
                       .select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
        found = self._verify(first)
        comp = components(found)
        # only lists with a member that its pivot is not linked to need another look
        lost = first.join(found, ["a", "b"], "left_anti")
        lost = staged(lost.union(self.posts.where("doc_id <> pivot").where(~self._fits("n", "pivot_n"))
                                 .select("pivot", "doc_id").distinct()), "unlinked")
        sent = F.broadcast if lost.count() <= MAX_SENT_PAIRS else (lambda df: df)
        odd = staged(self.posts.join(sent(lost.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"))), ["pivot", "doc_id"],
                                     "left_semi").select("key").distinct(), "odd-lists")
        sent = F.broadcast if odd.count() <= MAX_SENT_PAIRS else (lambda df: df)
        posts = self.posts.join(sent(odd), "key", "left_semi")
        posts = (posts.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .withColumn("component", F.coalesce("component", "doc_id")))
        low = posts.where("doc_id = pivot").select("key", F.col("component").alias("pivot_component"))
        posts = staged(posts.join(low, "key").where("doc_id <> pivot"), "list-components")
        out = posts.where("component <> pivot_component")
        # exact work of either way, per component of a pivot: pairs within lists, or pairs within the whole group
        by_list = (posts.groupBy("pivot_component", "key")
                   .agg(F.count("*").alias("m"), F.sum(F.expr("CAST(component <> pivot_component AS BIGINT)")).alias("o"))
                   .groupBy("pivot_component").agg(F.sum(F.expr("CAST(o AS DOUBLE) * m")).alias("list_work"), F.max("m").alias("longest")))
        docs = posts.select("pivot_component", "doc_id", "component", "n").distinct()
        touched = out.select("pivot_component").distinct()
        docs = staged(docs.join(touched, "pivot_component")
                      .withColumn("outside", F.expr("component <> pivot_component")), "group-members")
        group = docs.groupBy("pivot_component").agg(F.sum(F.expr("CAST(outside AS BIGINT)")).alias("o"),
                                                    F.count("*").alias("m"), F.avg("n").alias("size"))
        group = staged(group.join(by_list, "pivot_component")
                       .select("pivot_component", "o", "m", F.greatest(F.lit(1.0), F.col("size") * 8 * BLOCK / BLOCK_BYTES).alias("finer"),
                               F.expr(f"list_work > CAST(o AS DOUBLE) * m OR longest > {MAX_LIST}").alias("dense")), "groups")
        sparse = group.where("NOT dense").select("pivot_component")
        # a member outside the pivot's component meets every member of other components
        near = posts.join(sparse, "pivot_component")
        x = near.where("component <> pivot_component").select(
            "key", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
        y = near.select("key", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"),
                        "pivot_component")
        rest = (x.join(y, "key").where("cx <> cy").where((F.col("cy") == F.col("pivot_component")) | F.expr("x < y"))
                .where(self._fits("nx", "ny"))
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = staged(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
        self.n_pairs = (first, rest)
        return found.union(self._verify(rest)).union(self._blocks(docs, group.where("dense")))

    def _sets_of(self, ids: DataFrame) -> DataFrame:
        """(doc_id, s): shingle hashes of the documents in ``ids`` (and of a few
        more, for the caller's join to drop), from their whole texts."""
        bits = self.docs.sparkSession.sparkContext.broadcast(id_filter(ids, "doc_id"))
        words = self.words

        def run(batches):
            for b in batches:
                b = b.filter(pa.array(maybe_in(bits.value, np.asarray(b.column(2)))))
                for part, sets in _each_set([b], words):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                     ["doc_id", "s"])

        return map_arrow(self.docs.withColumn("slot", filter_slot("doc_id")), run, "doc_id long, s binary")

    def _blocks(self, docs: DataFrame, group: DataFrame) -> DataFrame:
        """Links within dense groups: outsiders against the pivot's component
        and against each other, BLOCK by BLOCK documents a task.  A task gives a
        spanning forest of its links, so no pairs are emitted."""
        percent = self.percent
        docs = docs.join(group.select("pivot_component", F.ceil(F.col("o") * F.col("finer") / BLOCK).cast("int").alias("bo"),
                                      F.ceil((F.col("m") - F.col("o")) * F.col("finer") / BLOCK).cast("int").alias("bm")), "pivot_component")
        part = F.pmod(F.xxhash64("doc_id"), F.when(F.col("outside"), F.col("bo")).otherwise(F.col("bm"))).cast("int")
        docs = staged(docs.withColumn("p", part), "dense-members")
        # where the members are few, they go to the texts and sets are shuffled once, to their blocks
        sent = F.broadcast if docs.count() <= MAX_SENT_MEMBERS else (lambda df: df)
        tasks = F.expr("""CASE WHEN outside THEN concat(
            transform(sequence(0, bo - 1), j -> struct(0 AS kind, least(p, j) AS i, greatest(p, j) AS j)),
            IF(bm > 0, transform(sequence(0, bm - 1), j -> struct(1 AS kind, p AS i, j AS j)), array()))
            ELSE transform(sequence(0, bo - 1), i -> struct(1 AS kind, i AS i, p AS j)) END""")
        rows = (self._sets_of(docs.select("doc_id").distinct()).join(sent(docs), "doc_id")
                .select("pivot_component", "doc_id", "component", "outside", "s", F.explode(tasks).alias("t"))
                .select("pivot_component", "t.kind", "t.i", "t.j", "doc_id", "component", "outside", "s"))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("doc_id")
            ids, comp = np.asarray(table["doc_id"]), np.asarray(table["component"])
            outside = np.asarray(table["outside"].combine_chunks().to_numpy(zero_copy_only=False))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["s"].combine_chunks()]
            sizes = np.array([len(s) for s in sets])
            inter = _intersections(sets)
            link = (inter > 0) & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter))
            link &= (comp[:, None] != comp[None, :]) & (outside[:, None] | outside[None, :])
            low = np.arange(len(ids))
            while True:
                now = np.minimum(low, np.where(link, low[None, :], len(ids)).min(1, initial=len(ids)))
                if (now == low).all():
                    break
                low = now
            move = low != np.arange(len(ids))
            return pa.table({"a": ids[low[move]], "b": ids[move]})

        ship(self.docs.sparkSession)
        return staged(rows.groupBy("pivot_component", "kind", "i", "j").applyInArrow(run, "a long, b long").distinct(), "links")

    def degrees(self, comp: DataFrame) -> DataFrame:
        """(rep, n_links): linked documents of other sets, for every representative
        in ``comp`` (node, component).  Links never leave a component, so its sets
        are compared with one another, block by block, and a task returns sums, no
        pairs; two sets alone in a component are linked.  Small components share
        a task."""
        percent = self.percent
        same = self.members.groupBy("rep").agg(F.count("*").alias("w"), F.max("n_shingles").alias("n"))
        docs = comp.select(F.col("node").alias("rep"), "component").join(same, "rep")
        group = docs.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("w").alias("all"))
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
        docs = staged(docs.join(group.withColumn("blocks", blocks), "component"), "component-sets")
        two = docs.where("m = 2").select("rep", (F.col("all") - F.col("w")).alias("links"))
        more = docs.where("m > 2")
        small = more.where("blocks = 1").agg(F.count("*").alias("m"), F.sum("n").alias("total")).first()
        shared = int(max(1, (small["m"] or 0) / BLOCK, (small["total"] or 0) * 8 / BLOCK_BYTES))
        part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        own = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(shared)))
        rows = more.select(F.col("rep").alias("doc_id"), "component", "w", "blocks", own.alias("task"), part.alias("p"))
        rows = (rows.join(self._sets_of(rows.select("doc_id")), "doc_id")
                .select("doc_id", "component", "w", "s", "p", (F.col("blocks") > 1).alias("large"), "task",
                        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
                .select("doc_id", "component", "w", "s", "p", "large", "task", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")))

        def run(key, table):
            comp, p, w = (np.asarray(table[c]) for c in ("component", "p", "w"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["s"].combine_chunks()]
            sizes = np.array([len(s) for s in sets])
            inter = _intersections(sets)
            link = (inter > 0) & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)) & (comp[:, None] == comp[None, :])
            if key[2].as_py() != key[3].as_py():
                link &= p[:, None] != p[None, :]
            np.fill_diagonal(link, False)
            return pa.table({"rep": table["doc_id"], "links": pa.array(link @ w, pa.int64())})

        ship(self.docs.sparkSession)
        found = rows.groupBy("large", "task", "i", "j").applyInArrow(run, "rep long, links long")
        return two.unionByName(found).groupBy("rep").agg(F.sum("links").alias("links"))

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, n_links, n_same): n_links other documents
        are linked directly, n_same documents have the same set (this one
        included).  One row per document (and distinct set)."""
        comp = staged(components(self.links()), "set-components")
        same = self.members.groupBy("rep").agg(F.count("*").alias("n_same"))
        low = (self.members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(same, "rep")
               .join(self.degrees(comp), "rep", "left"))
        alone = F.when(F.col("n_shingles") > 0, F.col("n_same") - 1).otherwise(0)
        return low.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"),
                          (F.coalesce("links", F.lit(0)) + alone).cast("long").alias("n_links"), "n_same")


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, n_same) of every document."""
    return JaccardJoin(docs, words, percent).run()


def one_per_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of linked
    documents (all columns)."""
    join = JaccardJoin(docs, words, percent)    # components are enough, links need not be counted
    comp = components(join.links())
    drop = (join.members.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .where(F.coalesce("component", "rep") != F.col("doc_id")).select("doc_id").distinct())
    return docs.join(staged(drop, "near-copies"), "doc_id", "left_anti").select(docs.columns)
