"""Discriminative phrase mining: n-grams, vocabulary, TF-IDF, chi-squared,
hit checks, candidate validation and the merged pattern table.

Tokens are cut once per document and placed by doc_id, in as many partitions as
the texts need, so that nothing spills.  The n-grams of a batch of documents, a
piece, are counted as numbers in Arrow and travel once, packed: to each part of the
hash range one row of the piece's terms there, each with the documents that hold it
as small numbers.  ``term_counts(term, df, tf_sum, by)`` has one row per term, with
the documents of each set of codes in the array ``by``, so the vocabulary is a
filter of it and chi-squared needs no join.  ``term_index`` keeps from the same pass
which documents hold a term, with a term's number in place of its text.  TF-IDF needs
no second look at the texts: those numbers are restricted to the vocabulary in their
part and go back to their piece, where documents are whole and have their norms; sums
by term and set of codes travel packed, too.  Best terms are first chosen within a
task.  The vocabulary has no cap unless ``max_features`` is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from labelflow.functions import text as tx
from labelflow.functions.stopwords import DUTCH_STOPWORDS
from labelflow.operators.labels import restrict_to_space
from labelflow.session import materialize, stage

# Fixed mining parameters
MIN_DF = 2
MAX_DF = 0.5
TOP_K = 25
MIN_POSITIVES = 1
VALID_MIN_PRECISION = 0.85
VALID_MIN_HITS = 3

#: Bytes of text in a partition, and tokens of which a task counts the n-grams at once.
PART_BYTES = 8 << 20
PIECE_TOKENS = 1 << 20
HASH_STEP = np.uint64(0x9E3779B97F4A7C15)

SRC_CHI2 = "data-derived-chi2"
SRC_TFIDF = "data-derived-tfidf"
SRC_VALID = "manual-valuelist"


def text_parts(docs: DataFrame) -> int:
    """Partitions in which the terms of the texts fit a task's memory."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def doc_tokens(docs: DataFrame, stopwords: Sequence[str] = DUTCH_STOPWORDS) -> DataFrame:
    """The columns of ``docs`` with the tokens, joined by spaces, in place of the text, by doc_id."""
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, _joined_tokens(stopwords).alias("_tokens")).repartition(text_parts(docs), "doc_id")


def _joined_tokens(stopwords: Sequence[str]):
    """Tokens, which hold no space, as one string: an array of them takes twice the bytes."""
    return F.array_join(tx.mining_tokens(F.col("text"), stopwords), " ")


def token_grams(tokens: DataFrame, n_max: int = 3) -> DataFrame:
    """One row (other columns, term) for each 1..n_max-gram of ``_tokens``."""
    keep = [c for c in tokens.columns if c != "_tokens"]
    at = tokens.select(*keep, "_tokens", F.posexplode("_tokens").alias("_i", "_w"))
    grams = [F.col("_w")]
    for n in range(1, n_max):   # null where the tokens end, and so is what is longer
        grams.append(F.concat(grams[-1], F.lit(" "), F.get("_tokens", F.col("_i") + n)))
    return at.select(*keep, F.explode(F.array(*grams)).alias("term")).where("term IS NOT NULL")


def _ints(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows after about PIECE_TOKENS tokens."""
    for b in batches:
        texts = b.column("_tokens")
        row = np.repeat(np.arange(len(b)), _ints(texts.value_lengths()))
        size = np.bincount(row, weights=_ints(pc.count_substring(texts.flatten(), " ")) + 1, minlength=len(b))
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE_TOKENS)) + 1), len(b)]
        yield from (b.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def _gram_counts(tokens: pa.ListArray, n_max: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n the texts of the n-grams in ``tokens`` (rows of texts of joined tokens),
    word by word in order, their hashes, and (number of the text, row, count) of those
    that a row holds, in this order."""
    lists = pc.split_pattern(tokens.flatten(), " ")
    lengths = _ints(lists.value_lengths())
    row = np.repeat(np.repeat(np.arange(len(tokens)), _ints(tokens.value_lengths())), lengths)
    part = np.repeat(np.arange(len(lists)), lengths)    # no n-gram runs from one list into the next
    held = _ints(pc.binary_length(lists.flatten())) > 0     # a text without tokens is split into one empty string
    row, part = row[held], part[held]
    coded = lists.flatten().filter(pa.array(held)).dictionary_encode()
    order = _ints(pc.sort_indices(coded.dictionary))
    word, words = np.argsort(order)[_ints(coded.indices)], coded.dictionary.take(pa.array(order))
    hashes = word_hashes = hash_array(np.array(words.to_pylist(), object), categorize=False)
    gram, texts, start = word, words, np.arange(len(word))
    for n in range(1, n_max + 1):
        if n > 1:
            fits = start + n - 1 < len(word)
            start, gram = start[fits], gram[fits]
            fits = part[start] == part[start + n - 1]
            start, gram = start[fits], gram[fits]
            kinds, gram = np.unique(gram * len(words) + word[start + n - 1], return_inverse=True)
        if not len(start):
            return
        if n > 1:
            head, last = kinds // len(words), kinds % len(words)
            texts = pc.binary_join_element_wise(texts.take(pa.array(head)), words.take(pa.array(last)), " ")
            hashes = hashes[head] * HASH_STEP + word_hashes[last]
        cell, count = np.unique(gram * len(tokens) + row[start], return_counts=True)
        yield texts, hashes, cell // len(tokens), cell % len(tokens), count


def doc_terms(docs: DataFrame, stopwords: Sequence[str] = DUTCH_STOPWORDS, n_max: int = 3) -> DataFrame:
    """O-N1: (doc_id, term, tf, other columns of ``docs`` but the text) over
    1..n_max-grams of the stopword-filtered tokens."""
    keep = [c for c in docs.columns if c != "text"]
    return _count_terms(doc_tokens(docs, stopwords).groupBy(*keep).agg(F.collect_list("_tokens").alias("_tokens")), n_max)


def _count_terms(tokens: DataFrame, n_max: int) -> DataFrame:
    """(other columns, term, tf) of rows of token lists, one row per document."""
    keep = [c for c in tokens.columns if c != "_tokens"]
    names = [*keep, "term", "tf"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            for texts, _, gram, row, tf in _gram_counts(b.column("_tokens"), n_max):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), texts.take(pa.array(gram)), pa.array(tf)], names)

    schema = StructType([*tokens.select(*keep).schema.fields]).add("term", StringType()).add("tf", LongType())
    return tokens.mapInArrow(count, schema)


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def coded_tokens(docs: DataFrame, truth: DataFrame, codes: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, codes, _tokens), one row per document: the array of its codes (of
    ``codes``) and the joined tokens of its texts, from one shuffle; in an order that
    a task run again repeats."""
    t = docs.select("doc_id", _joined_tokens(stopwords).alias("_t"), F.lit(None).cast("int").alias("_c"))
    y = (restrict_to_space(truth, codes.select("code").distinct()).where("doc_id IS NOT NULL")
         .select("doc_id", F.lit(None).cast("string").alias("_t"), F.col("code").cast("int").alias("_c")))
    return (t.unionByName(y).repartition(text_parts(docs), "doc_id")
            .groupBy("doc_id").agg(F.array_sort(F.collect_set("_c")).alias("codes"), F.array_sort(F.collect_list("_t")).alias("_tokens"))
            .where("size(_tokens) > 0").sortWithinPartitions("doc_id"))


TERM = "term string, df bigint, tf_sum bigint, by array<struct<codes: array<int>, value: double>>"
PIECE = "docs {}, sets array<string>, starts array<int>"
CELLS = "part int, piece bigint, n_terms bigint, n_pairs bigint, nums binary"


def term_counts(docs: DataFrame, truth: DataFrame, codes: DataFrame, stopwords: Sequence[str] = DUTCH_STOPWORDS,
                n_max: int = 3, min_df: int | None = None) -> DataFrame:
    """(term, df, tf_sum, by): documents and occurrences of each term, and in the
    array ``by`` its documents by their set of codes, from one pass over the texts.
    With ``min_df`` only the terms of so many documents, and the other rows of
    ``term_index``.

    The terms of a piece travel packed, one row for each part of the hash range, and
    a part is added up where its rows meet."""
    parts = text_parts(docs)
    ids = docs.schema["doc_id"].dataType
    piece = PIECE.format(ArrayType(ids).simpleString())
    packed = f"part int, piece bigint, n_sets bigint, n_terms bigint, n_pairs bigint, n_bytes bigint, terms binary, nums binary, {piece}"
    out = TERM if min_df is None else f"{TERM}, term_id bigint, {CELLS}, {piece}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(_pieces(batches)):
            number = (TaskContext.get().partitionId() << 32) + i
            keys = np.array([",".join(map(str, c)) for c in b.column("codes").to_pylist()])
            sets, own = np.unique(keys, return_inverse=True)
            by_set = np.argsort(own, kind="stable")     # documents are numbered set by set
            starts = np.searchsorted(own[by_set], np.arange(len(sets)))
            if min_df is not None:
                yield pa.RecordBatch.from_pydict({"part": [number % parts], "piece": [number], "docs": pa.ListArray.from_arrays(
                    pa.array([0, len(b)], pa.int32()), b.column("doc_id").take(pa.array(by_set))),
                    "sets": [sets.tolist()], "starts": [starts.tolist()]})
            found = [*_gram_counts(b.column("_tokens"), n_max)]
            if not found:
                continue
            first = np.cumsum([0, *(len(x[0]) for x in found)])
            texts = pa.concat_arrays([x[0] for x in found])
            part = ((np.concatenate([x[1] for x in found]) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            gram = np.concatenate([x[2] + f for x, f in zip(found, first)])
            row, tf = np.argsort(by_set)[np.concatenate([x[3] for x in found])], np.concatenate([x[4] for x in found])
            del found
            held, order, pairs = np.bincount(gram), np.argsort(part, kind="stable"), np.argsort(part[gram], kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            pair_ends = np.append(0, np.cumsum(held[order]))[ends]
            rows = []
            for p in np.flatnonzero(np.diff(ends)):
                some, of = order[ends[p]:ends[p + 1]], pairs[pair_ends[p]:pair_ends[p + 1]]
                text = "\n".join([*sets, *texts.take(pa.array(some)).to_pylist()]).encode()
                rows.append((p, number, len(sets), len(some), len(of), len(text), _zip(text, TEXT_LEVEL), _numbers(starts, held[some], row[of], tf[of])))
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "piece", "n_sets", "n_terms", "n_pairs", "n_bytes", "terms", "nums"), zip(*rows))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for b in batches:
            if len(own := b.filter(pc.is_valid(b["docs"]))):
                yield pa.RecordBatch.from_pydict({"piece": own["piece"], "docs": own["docs"], "sets": own["sets"], "starts": own["starts"]})
            for r in b.filter(pc.is_valid(b["terms"])).select(PACKED).to_pylist():
                by_part.setdefault(r["part"], []).append(r)
        while by_part:
            yield from _added(*by_part.popitem(), min_df)

    def whole(make: Callable, names: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            id_type = []

            def seen():
                for b in batches:
                    id_type[:] = [b.schema.field("doc_id").type if "doc_id" in b.schema.names else b.schema.field("docs").type.value_type]
                    yield b

            for x in make(seen()):
                kinds = TYPES | {"docs": pa.list_(id_type[0])}
                yield pa.RecordBatch.from_arrays([x[c].cast(kinds[c]) if c in x.schema.names else pa.nulls(len(x), kinds[c]) for c in names], names)
        return run

    rows = coded_tokens(docs, truth, codes, stopwords).mapInArrow(whole(count, [*PACKED, *PIECE_COLUMNS]), packed)
    names = ["term", "df", "tf_sum", "by"] + ([] if min_df is None else ["term_id", *CELL_COLUMNS, *PIECE_COLUMNS])
    return rows.repartition(parts, "part").mapInArrow(whole(add, names), out)


PACKED = ["part", "piece", "n_sets", "n_terms", "n_pairs", "n_bytes", "terms", "nums"]
CELL_COLUMNS = ["part", "piece", "n_terms", "n_pairs", "nums"]
PIECE_COLUMNS = ["docs", "sets", "starts"]
TYPES = {"part": pa.int32(), "terms": pa.binary(), "nums": pa.binary(), "sets": pa.list_(pa.string()), "starts": pa.list_(pa.int32()), "term": pa.string(),
         "by": pa.list_(pa.struct([("codes", pa.list_(pa.int32())), ("value", pa.float64())])),
         **dict.fromkeys(["piece", "n_sets", "n_terms", "n_pairs", "n_bytes", "df", "tf_sum", "term_id"], pa.int64())}
#: How hard terms are compressed.
TEXT_LEVEL = 3
#: A term's id is the number of its part, then in so many bits its number there.
TERM_BITS = 32


def _zip(data: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", level).compress(data, asbytes=True)


def _numbers(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, compressed byte by byte."""
    return _zip(b"".join(c.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns))


def _columns(data: bytes, *lengths: int) -> list[np.ndarray]:
    """The columns that ``_numbers`` packed."""
    raw, out, at = np.frombuffer(pa.decompress(data, 4 * sum(lengths), "zstd", asbytes=True), np.uint8), [], 0
    for n in lengths:
        out.append(raw[at:at + 4 * n].reshape(4, n).T.copy().view("<i4").reshape(n).astype(np.int64))
        at += 4 * n
    return out


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``length`` of them."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def _added(part: int, rows: list[dict], min_df: int | None) -> Iterator[pa.RecordBatch]:
    """``term_counts`` of the packed rows of one part; with ``min_df`` those of the terms
    kept, and the rows again, with the numbers of these terms."""
    sets: dict[str, int] = {}
    terms, held, cells, tfs = [], [], [], []
    rows.sort(key=lambda r: r["piece"])     # so that a task run again gives the same numbers
    for r in rows:
        text = pa.decompress(r["terms"], r["n_bytes"], "zstd", asbytes=True).decode().split("\n")
        terms.append(pa.array(text[r["n_sets"]:], pa.large_string()))
        starts, n, row, tf = _columns(r["nums"], r["n_sets"], r["n_terms"], r["n_pairs"], r["n_pairs"])
        own = np.array([sets.setdefault(x, len(sets)) for x in text[:r["n_sets"]]], np.int64)
        held.append(n)
        cells.append(own[np.searchsorted(starts, row, "right") - 1])
        tfs.append(tf)
        r["terms"] = None
    coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    del terms
    term = _ints(coded.indices)
    pair_term = np.repeat(term, np.concatenate(held))
    tf_sum = np.bincount(pair_term, weights=np.concatenate(tfs)).astype(np.int64)
    cell, df_cell = np.unique(pair_term * len(sets) + np.concatenate(cells), return_counts=True)
    del cells, tfs, pair_term
    term_cell = cell // len(sets)
    df = np.bincount(term_cell, weights=df_cell).astype(np.int64)
    kept = np.full(len(df), True) if min_df is None else df >= min_df
    mine = kept[term_cell]
    kinds = pa.array([[int(x) for x in k.split(",") if x] for k in sets], pa.list_(pa.int32()))
    of_set = pa.StructArray.from_arrays([kinds.take(pa.array(cell[mine] % len(sets))), pa.array(df_cell[mine].astype(np.float64))], ["codes", "value"])
    ends = np.searchsorted(term_cell[mine], np.append(np.flatnonzero(kept), len(kept))).astype(np.int32)
    if min_df is not None:
        number = np.cumsum(kept) - 1
        at = np.cumsum([0, *map(len, held)])
        seen = []
        for r, n, a, z in zip(rows, held, at, at[1:]):
            of = np.flatnonzero(kept[term[a:z]])
            if len(of):
                of = of[np.argsort(number[term[a:z][of]])]
                _, _, row, tf = _columns(r["nums"], r["n_sets"], r["n_terms"], r["n_pairs"], r["n_pairs"])
                pairs = _ranges(np.cumsum(n)[of] - n[of], n[of])
                seen.append((part, r["piece"], len(of), len(pairs), _numbers(np.diff(number[term[a:z][of]], prepend=0), n[of], row[pairs], tf[pairs])))
        if seen:
            yield pa.RecordBatch.from_pydict(dict(zip(CELL_COLUMNS, zip(*seen))))
    table = {"term": coded.dictionary.filter(pa.array(kept)).cast(pa.string()), "df": df[kept], "tf_sum": tf_sum[kept], "by": pa.ListArray.from_arrays(pa.array(ends), of_set)}
    if min_df is not None:
        table["term_id"] = (part << TERM_BITS) + np.arange(kept.sum())
    yield from pa.table(table).to_batches(max_chunksize=1 << 15)


@dataclass
class TermIndex:
    """``terms``: (term_id, term, df, tf_sum, by); ``seen``: packed (part, piece) rows of the
    terms' numbers, documents and tf; ``pieces``: the documents of a piece."""
    terms: DataFrame
    seen: DataFrame
    pieces: DataFrame
    parts: int


def term_index(docs: DataFrame, truth: DataFrame, codes: DataFrame, stopwords: Sequence[str] = DUTCH_STOPWORDS,
               n_max: int = 3, min_df: int = MIN_DF) -> TermIndex:
    """O-N1 and ``term_counts`` from one pass over the texts, staged: the terms of at least
    ``min_df`` documents with their counts, and the (doc_id, term, tf) of these, packed by
    piece and part with numbers for terms and documents."""
    rows = stage(term_counts(docs, truth, codes, stopwords, n_max, min_df), "terms", "zstd")
    return TermIndex(rows.where("term_id IS NOT NULL").select("term_id", "term", "df", "tf_sum", "by"),
                     rows.where("nums IS NOT NULL").select("part", "piece", "n_terms", "n_pairs", "nums"),
                     rows.where("docs IS NOT NULL").select("piece", "docs", "sets", "starts"), text_parts(docs))


def vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF,
               max_features: int | None = None) -> DataFrame:
    """O-N2: (term_id, term, df, tf_sum, by) with df >= min_df, df <= max_df * N; with
    ``max_features`` only that many terms with the highest corpus count (term
    order on ties), a per-partition top-n then a merge.  Staged, so that the ids
    stay; ``counts`` are ``term_counts``."""
    kept = (counts.crossJoin(F.broadcast(n_docs))   # one row
            .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("n_docs")))
            .drop("n_docs"))
    if max_features is not None:
        kept = kept.orderBy(F.col("tf_sum").desc(), F.col("term").asc()).limit(max_features)
    if "term_id" in counts.columns:     # a ``term_index`` has them on disk
        return kept if max_features is None else stage(kept, "vocabulary")
    return stage(kept.withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")


def restrict_to_vocab(index: TermIndex, vocab: DataFrame) -> DataFrame:
    """Keep the (doc_id, term, tf) of vocabulary terms, with their id and df: one row
    (piece, docs, sets, starts, cells) per piece, whose cells are packed by part.
    ``vocab``: any of the terms of the index, with their ``term_id``."""
    parts = index.parts
    low = np.int64((1 << TERM_BITS) - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, df = _ints(b["term_id"]), _ints(b["df"])
            order = np.argsort(number)
            number, df = number[order], df[order]
            part, first = np.unique(number >> TERM_BITS, return_index=True)
            rows = [(p, z - a, _numbers(number[a:z] & low, df[a:z])) for p, a, z in zip(part, first, [*first[1:], len(number)])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "nums"])

    def look_up(seen: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        got = [_columns(r["nums"], r["n"], r["n"]) for r in known.to_pylist()]
        if got and len(seen):
            number, df = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(number)
            number, df = number[order], df[order]
            for r in seen.to_pylist():
                step, held, row, tf = _columns(r["nums"], r["n_terms"], r["n_terms"], r["n_pairs"], r["n_pairs"])
                mine = np.cumsum(step)
                at = np.minimum(np.searchsorted(number, mine), len(number) - 1)
                of = np.flatnonzero(number[at] == mine)
                if len(of):
                    pairs = _ranges(np.cumsum(held)[of] - held[of], held[of])
                    rows.append((r["part"], r["piece"], len(of), len(pairs), _numbers(
                        np.diff(mine[of], prepend=0), df[at[of]], held[of], row[pairs], tf[pairs])))
        return pa.table([pa.array([r[i] for r in rows], TYPES[c]) for i, c in enumerate(CELL_COLUMNS)], CELL_COLUMNS)

    known = vocab.select("term_id", "df").mapInArrow(pack, "part int, n bigint, nums binary").repartition(parts, "part")
    cells = (index.seen.repartition(parts, "part").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(look_up, CELLS)
             .select("piece", F.struct("part", "n_terms", "n_pairs", "nums").alias("_cells")))
    pieces = index.pieces.select("*", F.lit(None).cast(cells.schema["_cells"].dataType).alias("_cells"))
    own = [F.first(c, ignorenulls=True).alias(c) for c in PIECE_COLUMNS]
    return (pieces.unionByName(cells, allowMissingColumns=True).repartition(parts, "piece").groupBy("piece")
            .agg(*own, F.collect_list("_cells").alias("cells")))


def _weights(piece: dict) -> tuple[list[tuple], np.ndarray]:
    """Of a piece of ``restrict_to_vocab`` (part, numbers of the terms, number of the
    document, w before the norm) by part, and the norms of its documents."""
    found, norm = [], np.zeros(len(piece["docs"]))
    for c in piece["cells"]:
        step, df, held, row, tf = _columns(c["nums"], *[c["n_terms"]] * 3, *[c["n_pairs"]] * 2)
        w = tf * np.repeat(np.log((1 + piece["n_docs"]) / (1 + df)) + 1, held)
        norm += np.bincount(row, w * w, minlength=len(norm))
        found.append((c["part"], np.repeat(np.cumsum(step), held), row, w))
    return found, np.sqrt(norm)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield {c: x[i].as_py() if c != "docs" else x[i].values for c, x in zip(b.schema.names, b.columns)}


def tfidf(dt_vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """O-N3: (doc_id, term_id, w) with w = tf * (ln((1+N)/(1+df)) + 1), L2-normalised
    per document; a document's terms are in its piece, and so is the norm."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _rows(batches):
            found, norm = _weights(piece)
            for part, number, row, w in found:
                yield pa.RecordBatch.from_arrays([piece["docs"].take(pa.array(row)), pa.array((part << TERM_BITS) + number),
                                                  pa.array(w / norm[row])], ["doc_id", "term_id", "w"])

    id_type = dt_vocab.schema["docs"].dataType.elementType.simpleString()
    return dt_vocab.crossJoin(F.broadcast(n_docs)).mapInArrow(weigh, f"doc_id {id_type}, term_id bigint, w double")   # one row


def _set_sums(dt_vocab: DataFrame, n_docs: DataFrame, parts: int) -> DataFrame:
    """(term_id, s_tot, by): the sums of ``tfidf`` over all documents and, in ``by``, over
    those of each set of codes; a piece's sums travel packed to the part of the terms."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _rows(batches):
            found, norm = _weights(piece)
            sets, starts, rows = piece["sets"], np.array(piece["starts"]), []
            for part, number, row, w in found:
                cell, at = np.unique(number * len(sets) + np.searchsorted(starts, row, "right") - 1, return_inverse=True)
                own, of = np.unique(cell % len(sets), return_inverse=True)
                rows.append((part, piece["piece"], [sets[i] for i in own], len(cell), _numbers(np.diff(cell // len(sets), prepend=0), of),
                             np.bincount(at, w / norm[row]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                by_part.setdefault(r["part"], []).append(r)
        while by_part:
            part, rows = by_part.popitem()
            sets: dict[str, int] = {}
            cells, values = [], []
            for r in sorted(rows, key=lambda r: r["piece"]):
                step, of = _columns(r["nums"], r["n"], r["n"])
                cells.append((np.cumsum(step), np.array([sets.setdefault(x, len(sets)) for x in r["sets"]], np.int64)[of]))
                values.append(np.frombuffer(r["sums"]))
            number, of = (np.concatenate(x) for x in zip(*cells))
            cell, at = np.unique(number * len(sets) + of, return_inverse=True)
            value = np.bincount(at, np.concatenate(values))
            term, first = np.unique(cell // len(sets), return_index=True)
            kinds = pa.array([[int(x) for x in k.split(",") if x] for k in sets], pa.list_(pa.int32()))
            by = pa.StructArray.from_arrays([kinds.take(pa.array(cell % len(sets))), pa.array(value)], ["codes", "value"])
            table = pa.table({"term_id": (part << TERM_BITS) + term, "s_tot": np.add.reduceat(value, first),
                              "by": pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), by)})
            yield from table.to_batches(max_chunksize=1 << 15)

    names, kinds = ["part", "piece", "sets", "n", "nums", "sums"], [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary()]
    packed = dt_vocab.crossJoin(F.broadcast(n_docs)).mapInArrow(   # one row
        add, "part int, piece bigint, sets array<string>, n bigint, nums binary, sums binary")
    return packed.repartition(parts, "part").mapInArrow(merge, "term_id bigint, s_tot double, by array<struct<codes: array<int>, value: double>>")


def _code_sizes(truth: DataFrame, docs: DataFrame, codes: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(code, n_pos, n_docs) for the requested codes, positives within ``docs``."""
    pos = (truth.join(docs.select("doc_id"), "doc_id", "left_semi")
           .groupBy("code").agg(F.countDistinct("doc_id").alias("n_pos")))
    return (codes.select("code").distinct().join(pos, "code", "left").crossJoin(F.broadcast(n_docs))
            .select("code", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), "n_docs"))


def _top_k(scored: DataFrame, col: str, k: int) -> DataFrame:
    w = Window.partitionBy("code").orderBy(F.col(col).desc(), F.col("term").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _near_top(rows: DataFrame, key: str, total: str, sizes: DataFrame, score: Callable, k: int) -> DataFrame:
    """(code, key, value, total): of rows (key, total, by) the sums of ``by`` over the
    sets that hold a code, where they may be among the code's k best of a
    partition.  ``score(value, total, n_pos, n_docs)`` is the score before it is
    rounded; what rounding may change is kept, and of equal scores the first k
    terms (all, if ``key`` is no term)."""
    known = sorted((r["code"], r["n_pos"], r["n_docs"]) for r in sizes.collect())   # a row per code
    at, pos, n = (np.array([r[i] for r in known], t) for i, t in enumerate((np.int64, np.float64, np.float64)))
    names = ["slot", "score", key, "value", total]

    def first(held: pa.Table, floor: np.ndarray) -> pa.Table:
        held = held.sort_by([("slot", "ascending"), ("score", "descending"), (key, "ascending")])
        slot, x = np.asarray(held["slot"]), np.asarray(held["score"])
        new = np.append(True, slot[1:] != slot[:-1])
        begin = np.flatnonzero(new)
        last = begin + k - 1
        full = last < np.append(begin[1:], len(slot))
        worst = x[last[full]]
        floor[slot[begin[full]]] = worst - 2e-12 - 1e-12 * worst
        keep = x >= floor[slot]
        if key == "term":
            new[1:] |= x[1:] != x[:-1]
            keep &= np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k
        return held.filter(pa.array(keep))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held = np.zeros(len(at)), None
        for b in batches:
            by = b.column("by")
            own, value = by.flatten().flatten()
            lengths = _ints(own.value_lengths())
            row = np.repeat(np.repeat(np.arange(len(b)), _ints(by.value_lengths())), lengths)
            code, value = _ints(own.flatten()), np.repeat(np.asarray(value), lengths)
            mine = np.isin(code, at)
            cell, to = np.unique(row[mine] * len(at) + np.searchsorted(at, code[mine]), return_inverse=True)
            if not len(cell):
                continue
            value, row, slot = np.bincount(to, weights=value[mine]), cell // len(at), cell % len(at)
            whole = np.asarray(b.column(total)).astype(np.float64)[row]
            x = score(value, whole, pos[slot], n[slot])
            use = (x > 0) & (x >= floor[slot])
            if use.any():
                found = pa.table([pa.array(slot[use]), pa.array(x[use]), b.column(key).take(pa.array(row[use])), pa.array(value[use]),
                                  pa.array(whole[use])], names)
                held = first(found if held is None else pa.concat_tables([held, found]), floor)
        if held is not None:
            held = held.set_column(0, "code", pa.array(at[np.asarray(held["slot"])].astype(np.int32)))
            yield from held.drop_columns("score").combine_chunks().to_batches()

    kind = dict(rows.dtypes)[key]
    return rows.select(key, total, "by").mapInArrow(best, f"code int, {key} {kind}, value double, {total} double")


def mine_tfidf(docs: DataFrame, vocab: DataFrame, truth: DataFrame, codes: DataFrame, n_docs: DataFrame,
               k: int = TOP_K, stopwords: Sequence[str] = DUTCH_STOPWORDS, n_max: int = 3, index: TermIndex | None = None) -> DataFrame:
    """O-N4: per code the top-k terms by mean TF-IDF over positive documents
    minus mean over negative documents, keeping differences > 0.  ``index`` is the
    one of ``docs`` and ``truth`` that ``vocab`` was taken from, if there is one."""
    if index is None:
        index = term_index(docs, truth, codes, stopwords, n_max, min_df=1)
        vocab = index.terms.select("term_id", "term").join(vocab.select("term", "df"), "term")
    sums = _set_sums(restrict_to_vocab(index, vocab), n_docs, index.parts)
    sizes = materialize(_code_sizes(truth, docs, codes, n_docs).where(
        (F.col("n_pos") >= MIN_POSITIVES) & (F.col("n_docs") - F.col("n_pos") > 0)))
    near = _near_top(sums, "term_id", "s_tot", sizes, lambda s, tot, n1, n: s / n1 - (tot - s) / (n - n1), k)
    diff = (F.col("value") / F.col("n_pos")
            - (F.col("s_tot") - F.col("value")) / (F.col("n_docs") - F.col("n_pos")))
    scored = (near.join(F.broadcast(sizes), "code")   # a row per code
              .select("code", "term_id", F.round(diff, 12).alias("score")).where(F.col("score") > 0))
    w = Window.partitionBy("code").orderBy(F.col("score").desc())
    scored = stage(scored.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r"), "near-top")
    return _top_k(scored.join(vocab.select("term_id", "term"), "term_id").select("code", "term", "score"), "score", k)


def mine_chi2(docs: DataFrame, vocab: DataFrame, truth: DataFrame, codes: DataFrame, n_docs: DataFrame,
              k: int = TOP_K) -> DataFrame:
    """O-N5: per code the top-k terms by one-vs-rest chi-squared on term
    presence; only terms seen in a positive document; NaN/inf -> 0.  ``vocab``
    is of the same documents and codes."""
    sizes = materialize(_code_sizes(truth, docs, codes, n_docs).where(F.col("n_pos") >= MIN_POSITIVES))

    def chi2(a, df, n1, n):
        e1, e0 = df * (n1 / n), df * ((n - n1) / n)
        return np.where(e0 > 0, (a - e1) * (a - e1) / e1 + ((df - a) - e0) * ((df - a) - e0) / np.where(e0 > 0, e0, 1), 0.0)

    near = _near_top(vocab, "term", "df", sizes, chi2, k)
    a, df, n, n1 = F.col("value"), F.col("df"), F.col("n_docs"), F.col("n_pos")
    e1 = df * (n1 / n)
    e0 = df * ((n - n1) / n)
    chi = F.when(e0 > 0, (a - e1) * (a - e1) / e1 + ((df - a) - e0) * ((df - a) - e0) / e0).otherwise(F.lit(0.0))
    scored = (near.join(F.broadcast(sizes), "code")   # a row per code
              .select("code", "term", F.round(chi, 12).alias("score")).where(F.col("score") > 0))
    return _top_k(scored, "score", k)


def terms_with_hits(terms: DataFrame, docs: DataFrame, n_max: int = 3) -> DataFrame:
    """O-N6: mined terms that occur as a contiguous n-gram of the token stream
    *without* stopword removal in at least one document."""
    t = stage(terms.select("term").distinct(), "terms")   # its size is known: the n-grams need not be shuffled
    tokens = docs.select(tx.mining_tokens(F.col("text"), ()).alias("_tokens"))
    return token_grams(tokens, n_max).join(t, "term", "left_semi").distinct()


def merge_mined(chi2: DataFrame, tfidf_terms: DataFrame, has_hits: DataFrame) -> DataFrame:
    """O-N7: all chi2 terms with hits, then TF-IDF terms with hits that chi2
    did not keep for the same code: (code, source, term, rank)."""
    hh = has_hits.select("term")
    c = chi2.join(hh, "term", "left_semi").select("code", F.lit(SRC_CHI2).alias("source"), "term", "rank")
    t = (tfidf_terms.join(hh, "term", "left_semi").join(c.select("code", "term"), ["code", "term"], "left_anti")
         .select("code", F.lit(SRC_TFIDF).alias("source"), "term", "rank"))
    return c.unionByName(t)


def validate_candidates(cands: DataFrame, titles: DataFrame, truth: DataFrame,
                        min_hits: int = VALID_MIN_HITS, min_precision: float = VALID_MIN_PRECISION) -> DataFrame:
    """O-N8: keep candidate phrases whose word-bounded hits in the (lower-case)
    title zone number at least ``min_hits`` with precision >= ``min_precision``.

    A phrase that starts and ends with a word character occurs word-bounded
    exactly when it equals a span of complete word runs, so hits are an equi-join
    on the span; other phrases join on their first inner word run and are tested
    by regex on the few titles that hold it.  A (code, phrase) that is listed
    twice is counted once for each entry.
    """
    wc = r"[\p{L}\p{N}_]"
    c = (cands.withColumn("low", F.lower("phrase")).withColumn("cand_id", F.monotonically_increasing_id())
         .withColumn("runs", F.regexp_extract_all("low", F.lit(wc + "+"), 0))
         .withColumn("edged", F.col("low").rlike(f"(?s)^{wc}(?:.*{wc})?$")))
    c = materialize(c)   # the id is fixed before the table is used twice
    lengths = [r["k"] for r in c.where("edged").select(F.size("runs").alias("k")).distinct().collect()]
    t = titles.select("doc_id", "title")
    spans = t.select("doc_id", F.explode(tx.run_spans(F.col("title"), sorted({*lengths, 1}), wc)).alias("span"))
    exact = spans.join(c.where("edged").select("cand_id", F.col("low").alias("span")), "span").select("doc_id", "cand_id")
    near = c.where("NOT edged AND size(runs) > 0").select(
        "cand_id", F.element_at("runs", 1).alias("span"),
        F.concat(F.lit(f"(?<!{wc})"), tx.regex_escape(F.col("low")), F.lit(f"(?!{wc})")).alias("rx"))
    rest = (spans.join(near, "span").join(t, "doc_id").where(F.regexp_like("title", "rx")).select("doc_id", "cand_id"))
    hits = exact.unionByName(rest).distinct().join(c.select("cand_id", "code"), "cand_id")
    y = truth.select("doc_id", "code", F.lit(1).alias("_y"))
    agg = (hits.join(y, ["doc_id", "code"], "left").groupBy("cand_id")
           .agg(F.count(F.lit(1)).alias("hits_total"), F.count("_y").alias("hits_pos")))
    prec = F.col("hits_pos") / F.col("hits_total")
    return (agg.where((F.col("hits_total") >= min_hits) & (prec >= F.lit(float(min_precision))))
            .join(c.select("cand_id", "code", "phrase", "name"), "cand_id")
            .select("code", "phrase", "name", F.round(prec, 3).alias("precision"), "hits_pos", "hits_total"))


def build_pattern_table(curated: DataFrame, mined: DataFrame, validated: DataFrame | None,
                        codes: DataFrame, title_phrases: DataFrame | None = None) -> DataFrame:
    """O-N9: union of curated phrases, mined terms and validated candidates,
    restricted to ``codes``; validated phrases already listed (same code,
    lower-case phrase) in ``title_phrases`` are dropped.  Ids per (code, source)."""
    from labelflow.operators import patterns as pt
    cur = pt.from_phrases(curated.join(codes.select("code").distinct(), "code", "left_semi"))
    m = mined.join(codes.select("code").distinct(), "code", "left_semi").select(
        "code", "source", F.col("term").alias("source_text"),
        F.concat(F.lit(r"(?i)\b"), tx.regex_escape(F.col("term")), F.lit(r"\b")).alias("regex"),
        F.lit(None).cast("string").alias("name"), F.lit("full").alias("match_zone"),
        F.lit(False).alias("fuzzy_gap"), F.lit(False).alias("is_regex"), F.col("rank").alias("ord"))
    parts = [cur.select(*m.columns, "pattern_id"), pt.with_ids(m)]
    if validated is not None:
        v = validated.join(codes.select("code").distinct(), "code", "left_semi")
        if title_phrases is not None:
            seen = title_phrases.select("code", F.lower("phrase").alias("_low"))
            v = v.withColumn("_low", F.lower("phrase")).join(seen, ["code", "_low"], "left_anti").drop("_low")
        v = v.select("code", F.lit(SRC_VALID).alias("source"), F.col("phrase").alias("source_text"),
                     tx.phrase_regex(F.col("phrase"), True).alias("regex"), "name",
                     F.lit("title").alias("match_zone"), F.lit(True).alias("fuzzy_gap"), F.lit(False).alias("is_regex"),
                     F.dense_rank().over(Window.partitionBy("code").orderBy("phrase")).alias("ord"))
        parts.append(pt.with_ids(v.where(F.col("regex") != "")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out
