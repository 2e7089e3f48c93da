"""Score newly arriving document files with frozen weights and thresholds.

A Structured Streaming file source reads new Parquet files of documents;
each micro-batch is matched against the static pattern table,
scored with the frozen per-pattern weights, thresholded per code and
appended to the prediction contract.  The checkpoint location keeps track of
processed files, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.operators import matching, scoring, thresholds

DOC_SCHEMA = "doc_id BIGINT, text STRING"


def score_batch(docs: DataFrame, patterns: DataFrame, weights: DataFrame, th: DataFrame,
                prefix_rx: str | None = None, inclusive: bool = True) -> DataFrame:
    """Sparse (doc_id, code, score, predicted) for one batch of documents."""
    if prefix_rx:
        docs = docs.select("doc_id", tx.strip_prefix(F.col("text"), prefix_rx).alias("text"))
    hits = matching.match_patterns(docs, patterns, prefix_rx)
    s = scoring.doc_code_score(hits, weights)
    return thresholds.apply_thresholds(s, th, inclusive=inclusive)


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
          patterns: DataFrame, weights: DataFrame, th: DataFrame, method: str,
          prefix_rx: str | None = None, available_now: bool = True):
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    stream = spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = score_batch(batch, patterns, weights, th, prefix_rx).withColumn("method", F.lit(method))
        # a batch that is retried overwrites its own partition instead of adding its rows twice
        (out.select("doc_id", "code", F.col("score").cast("float").alias("score"), "predicted", "method",
                    F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "batch_id").parquet(sink_dir))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
