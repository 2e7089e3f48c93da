"""Token counts with a digest cache.

A count is stored under the digest of the normalised content (runs of ASCII
white space as one space, which the tokenizer drops anyway) and the digest of
the tokenizer file.  Documents join the stored counts by digest; of the digests
that are missing one document each is encoded; the new counts are appended to
the cache table.

Null texts are empty.  Every input row gives one output row, repeated ones too.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm.common import filter_slot, id_filter, map_arrow, maybe_in, staged, text_chunks
from labelflow.llm.word_tokens import CHUNK_BYTES, word_tokens

LIMIT = 2048
CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def content_digest(text: str = "text"):
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r]+", " ")
    return F.unhex(F.sha2(plain, 256))


class CountCache:
    """A table of counts in shared storage, partitioned by tokenizer version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, version: str) -> DataFrame:
        """(digest, n_tokens) of one version; a digest that two jobs stored counts once."""
        if not self._exists():
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", "n_tokens", F.lit(version).alias("version")).write.partitionBy("version").mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: CountCache, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    version = hashlib.sha256(spec).hexdigest()
    docs = docs.select("doc_id", "text")
    keys = staged(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                              content_digest().alias("digest")), "content-digests")
    stored = staged(cache.read(version), "stored-counts")
    first = (keys.join(stored, "digest", "left_anti").groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first")))
    first = staged(first, "missing-digests")
    fresh = staged(_encode_missing(docs, keys, first, spec), "fresh-counts")
    cache.append(fresh, version)
    return (keys.join(stored.union(fresh), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def _encode_missing(docs: DataFrame, keys: DataFrame, first: DataFrame, spec: bytes) -> DataFrame:
    """(digest, n_tokens) of one document for each missing digest.  Documents
    that need no encoding (stored, or not the first of their digest) set bits in
    a small filter: texts it does not touch are encoded where they are read, the
    few others are joined exactly first."""
    sc = docs.sparkSession.sparkContext
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    skip = keys.select(F.coalesce("doc_id", F.lit(-1)).alias("first"), "digest")
    # an id that comes with several contents, or twice, is joined exactly
    often = skip.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first")
    skip = skip.join(first, ["first", "digest"], "left_anti").select("first").union(often)
    bits = sc.broadcast(id_filter(skip, "first"))
    shared = sc.broadcast(spec)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(bits.value, np.asarray(b.column(2))))).select([0, 1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(shared.value)
        for b in batches:
            if "slot" in b.schema.names:
                b = b.filter(pa.array(~maybe_in(bits.value, np.asarray(b.column(2)))))
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                n, _ = tokens.encode(part.column(1), ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["first", "n_tokens"])

    slotted = rows.select(F.col("id").alias("first"), "text", filter_slot("id").alias("slot"))
    untouched = map_arrow(slotted, encode, "first long, n_tokens long").join(first, "first").select("digest", "n_tokens")
    again = (map_arrow(slotted, touched, "first long, text string").withColumn("digest", content_digest())
             .join(first, ["first", "digest"]).dropDuplicates(["digest"]).select("digest", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(shared.value)
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                n, _ = tokens.encode(part.column(1), ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["digest", "n_tokens"])

    return untouched.union(map_arrow(again, count, "digest binary, n_tokens long"))
