"""Corpus preparation: five operators of ``labelflow.llm`` in a row.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's documents.  All stages but the
last return the columns of ``documents``.

1. quality         documents that the quality classifier rejects go
2. near_copies     of each group of linked documents the smallest id stays
3. benchmark       documents that hold a benchmark window go
4. secrets         owner-specific credentials are replaced by a mark
5. byte_bpe        doc_id, n_tokens, ids (little-endian unsigned 32-bit), and
                   whether they decode to the text

Null texts count as empty throughout, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import byte_bpe, decontam, ngram_join, quality, secrets
from labelflow.llm.queries import byte_vocabulary
from labelflow.session import scratch_path
from labelflow.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = byte_bpe.round_trip(docs, byte_vocabulary(), keep=["text"])
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")).alias("exact"))


STAGES = [("quality", quality_stage), ("near_copies", near_copy_stage), ("benchmark", benchmark_stage),
          ("secrets", secret_stage), ("byte_bpe", byte_bpe_stage)]

#: No SQL can express the classifier or the tokenizer; tests/llm compares run()
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
