"""Incremental scoring of new document files equals the batch scorer."""
import os
import tempfile

from labelflow.streaming import score_stream


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp()
    src, sink, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, "cat and dog")], score_stream.DOC_SCHEMA)
    docs.write.parquet(src)
    pats = spark.createDataFrame([("c", 1, "cat", "full", True), ("d", 2, "dog", "full", True)],
                                 "pattern_id STRING, code INT, source_text STRING, match_zone STRING, fuzzy_gap BOOLEAN")
    w = spark.createDataFrame([("c", 0.8), ("d", 0.6)], "pattern_id STRING, weight DOUBLE")
    th = spark.createDataFrame([(1, 0.5), (2, 0.7)], "code INT, threshold DOUBLE")
    q = score_stream.start(spark, src, sink, ck, pats, w, th, "seed")
    q.awaitTermination(120)
    got = {(r.doc_id, r.code, r.predicted) for r in spark.read.parquet(sink).collect()}
    want = {(r.doc_id, r.code, r.predicted) for r in score_stream.score_batch(docs, pats, w, th).collect()}
    assert got == want == {(1, 1, True), (2, 2, False), (3, 1, True), (3, 2, False)}
