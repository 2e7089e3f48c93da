"""Benchmark decontamination by winnowing, in SQL expressions only.

The text of a document or benchmark item, A-Z lower-cased, is cut into words.
Of every WINDOW - K + 1 consecutive K-word grams the one with the smallest hash
(the leftmost if tied) is a fingerprint, so any WINDOW words that a document
shares with an item give both the same fingerprint at the same place.  Document
and item fingerprints are joined; each common one fixes an alignment, which is
extended over the whole item by comparing words: every run of WINDOW equal
words is a hit.  An item of fewer words is matched as one window, by the hash of
all its words.

Null texts have no words.  Rows count one by one, repeated ones too.  Benchmark
rows with a null id are ignored; an item id that comes with several texts owns
the windows of all of them.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import staged

WINDOW = 10
K = 5
#: Low bits of a fingerprint that hold its word position.
POS_BITS = 27
#: Largest side, in bytes as counted before the choice, that is broadcast; a
#: larger one is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast row besides its texts.
ROW_BYTES = 48

SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str = "text") -> str:
    low = (f"CASE WHEN octet_length({text}) = length({text}) THEN lower({text}) "
           f"ELSE translate({text}, '{UPPER}', '{LOWER}') END")
    return f"array_remove(split(coalesce({low}, ''), '{SEPARATORS}'), '')"


def _gram(h: str, i: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"{h}[{i} + {j}]" for j in range(k)) + ")"


def winnow_sql(words: str, window: int, k: int) -> str:
    """Array of fingerprints: hash in the high bits, word position below."""
    span = window - k + 1
    grams = f"transform(sequence(0, size(h) - {k}), i -> shiftleft({_gram('h', 'i', k)}, {POS_BITS}) | i)"
    picks = f"array_distinct(transform(sequence(1, size(v) - {span - 1}), i -> array_min(slice(v, i, {span}))))"
    return let(f"transform({words}, w -> xxhash64(w))", "h",
               f"IF(size(h) >= {window}, {let(grams, 'v', picks)}, CAST(array() AS ARRAY<BIGINT>))")


def whole_sql(words: str, m: int) -> str:
    """Array of (hash, position) of all m-word grams; the length counts in the hash."""
    gram = _gram("h", "i", m)[:-1] + f", {m})"
    grams = f"transform(sequence(0, size(h) - {m}), i -> shiftleft({gram}, {POS_BITS}) | i)"
    return let(f"transform({words}, w -> xxhash64(w))", "h",
               f"IF(size(h) >= {m}, {grams}, CAST(array() AS ARRAY<BIGINT>))")


def prints_sql(words: str, lengths: list[int], window: int, k: int) -> str:
    """Fingerprints for windows of all the lengths, in one array: winnowed grams
    for ``window`` words, all grams for fewer."""
    each = [winnow_sql("w", window, k) if m == window else whole_sql("w", m) for m in lengths]
    return let(words, "w", f"concat({', '.join(each)})")


def _exploded(df: DataFrame, prints: str, *cols) -> DataFrame:
    return (df.select(*cols, F.explode(F.expr(prints)).alias("v"))
            .select(*cols, F.expr(f"shiftright(v, {POS_BITS})").alias("fp"),
                    F.expr(f"CAST(v & {(1 << POS_BITS) - 1} AS INT)").alias("pos")))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """All columns of ``docs`` and n_words, hits (array of start, end, item_id:
    word positions, end exclusive), n_hit and items (sorted ids as strings)."""
    items = staged(benchmark.where("item_id is not null").select("item_id", F.expr(words_sql()).alias("iw"))
                   .where("size(iw) > 0").select("item_id", F.array_join("iw", " ").alias("iw"),
                                          F.least(F.size("iw"), F.lit(window)).alias("m")).distinct(), "benchmark-words")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", key.alias("text_key"), "text").where("text is not null")
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())   # at most ``window`` numbers
    if lengths:
        marks = items.where("false").select("item_id", "iw", "m", F.lit(0).cast("long").alias("fp"), F.lit(0).alias("q"))
        for m in lengths:   # an item has the marks of its own length
            own = _exploded(items.where(F.col("m") == m), prints_sql("split(iw, ' ')", [m], window, k), "item_id", "iw", "m")
            marks = marks.union(own)
        marks = staged(marks, "benchmark-prints")
        near = (_exploded(rows, prints_sql(words_sql(), lengths, window, k), "doc_id", "text_key")
                .join(_small(marks, marks.agg(F.sum(F.length("iw") * 2 + ROW_BYTES)).first()[0] or 0), "fp")
                .select("doc_id", "text_key", "item_id", "iw", "m", (F.col("pos") - F.col("q")).alias("d")))
    else:
        near = rows.where("false").select("doc_id", "text_key", F.lit(0).alias("item_id"),
                                          F.lit("").alias("iw"), F.lit(1).alias("m"), F.lit(0).alias("d"))
    # a document's row holds an item's text once, however often passages of it are repeated
    found = staged(near.groupBy("doc_id", "text_key", "item_id", "iw", "m").agg(F.sort_array(F.collect_set("d")).alias("ds"))
                   .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "iw", "m", "ds")).alias("near")), "alignments")
    size = found.agg(F.sum(F.aggregate("near", F.lit(0), lambda a, x: a + F.length(x["iw"]) * 2 + F.size(x["ds"]) * 4 + ROW_BYTES))
                     ).first()[0] or 0
    names = docs.columns
    wide = (docs.select(F.struct(*names).alias("doc"), F.col("doc_id").alias("l_id"), key.alias("l_key"),
                        F.expr(words_sql()).alias("words"))
            .join(_small(found, size), F.col("l_id").eqNullSafe(F.col("doc_id")) & (F.col("l_key") == F.col("text_key")),
                  "left").select("doc", "words", "near"))
    wide = wide.withColumn("near", F.expr("transform(near, x -> struct(x.item_id, split(x.iw, ' ') AS iw, x.m, x.ds))"))
    starts = """filter(IF(least(size(x.iw), size(words) - d) - x.m >= greatest(0, -d),
                  sequence(greatest(0, -d), least(size(x.iw), size(words) - d) - x.m), CAST(array() AS ARRAY<INT>)),
                  j -> NOT exists(sequence(0, x.m - 1), t -> x.iw[j + t] <> words[d + j + t]))"""
    hits = f"""IF(near IS NULL, NULL, array_distinct(flatten(transform(near, x -> flatten(transform(x.ds, d -> transform({starts},
               j -> struct(d + j AS start, d + j + x.m AS end, CAST(x.item_id AS STRING) AS item_id))))))))"""
    wide = wide.select("doc", F.size("words").cast("long").alias("n_words"), F.expr(hits).alias("hits"))
    covered = """CAST(coalesce(aggregate(array_sort(transform(hits, h -> struct(h.start, h.end))),
                 struct(0 AS total, 0 AS upto),
                 (a, h) -> struct(a.total + greatest(0, h.end - greatest(h.start, a.upto)) AS total,
                                  greatest(a.upto, h.end) AS upto), a -> a.total), 0) AS BIGINT)"""
    return wide.select("doc", "n_words", "hits", F.expr(covered).alias("n_hit"),
                       F.expr("coalesce(array_sort(array_distinct(transform(hits, h -> h.item_id))), "
                              "CAST(array() AS ARRAY<STRING>))").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontaminate(docs.select("doc_id", "text"), benchmark, window, k).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    return decontaminate(docs, benchmark, window, k).where("n_hit = 0").select("doc.*")
