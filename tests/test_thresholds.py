"""Threshold search against exhaustive search."""
import random

import numpy as np
from pyspark.sql import functions as F

from labelflow.operators import thresholds


def exhaustive(scores, y):
    best_f1, best_t = 0.0, None
    for t in sorted(set(s for s in scores if s > 0)):
        pred = [s >= t for s in scores]
        tp = sum(p and yy for p, yy in zip(pred, y))
        if tp == 0:
            continue
        fp = sum(pred) - tp
        fn = sum(y) - tp
        f1 = 2 * tp / (2 * tp + fp + fn)
        if f1 > best_f1 + 1e-12:
            best_f1, best_t = f1, t
    return best_t


def test_exact_matches_exhaustive(spark):
    rng = random.Random(3)
    rows, truth, expect = [], [], {}
    for code in range(6):
        sc = [round(rng.choice([0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]), 2) for _ in range(40)]
        y = [rng.random() < 0.3 for _ in range(40)]
        expect[code] = exhaustive(sc, y) if any(y) else None
        rows += [(d, code, s) for d, s in enumerate(sc) if s > 0]
        truth += [(d, code) for d, yy in enumerate(y) if yy]
    s = spark.createDataFrame(rows, "doc_id BIGINT, code INT, score DOUBLE")
    t = spark.createDataFrame(truth, "doc_id BIGINT, code INT")
    got = {r.code: r.threshold for r in thresholds.tune_exact(s, t).collect()}
    for code, t_exp in expect.items():
        assert got.get(code) == t_exp


def test_no_positives_never_predicted(spark):
    s = spark.createDataFrame([(0, 1, 0.5)], "doc_id BIGINT, code INT, score DOUBLE")
    t = spark.createDataFrame([(0, 2)], "doc_id BIGINT, code INT")
    th = thresholds.tune_exact(s, t)
    assert th.where(F.col("code") == 1).count() == 0
    p = thresholds.apply_thresholds(s, th).collect()
    assert p[0].predicted is False


def test_inclusive_vs_strict(spark):
    s = spark.createDataFrame([(0, 1, 0.5)], "doc_id BIGINT, code INT, score DOUBLE")
    th = spark.createDataFrame([(1, 0.5)], "code INT, threshold DOUBLE")
    assert thresholds.apply_thresholds(s, th, inclusive=True).first().predicted is True
    assert thresholds.apply_thresholds(s, th, inclusive=False).first().predicted is False


def test_grid_tie_takes_lowest(spark):
    # scores 0.8 positive only: every grid value below 0.8 gives F1 = 1 -> first (0.10)
    s = spark.createDataFrame([(0, 1, 0.8), (1, 1, 0.05)], "doc_id BIGINT, code INT, score DOUBLE")
    t = spark.createDataFrame([(0, 1)], "doc_id BIGINT, code INT")
    th = thresholds.tune_grid(s, t).first()
    assert abs(th.threshold - 0.1) < 1e-12
    assert len(thresholds.grid_values()) == 13
    assert np.isclose(thresholds.grid_values()[-1], 0.7)


def test_cv_predictions_survive_sort_merge_joins(spark, tmp_path):
    """Without a broadcast both sides of the join with the truth are shuffled."""
    from labelflow.plans import catalog
    catalog.load_all()
    langs = [("en", "the and that"), ("fr", "les dans une"), ("de", "und nicht"), ("es", "los para del")]
    docs = [(i, f"Prefix. {langs[i % 4][1]} {langs[i * 7 % 3][1]}", langs[i % 4][0], f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 5 // 4) for i in range(0, 60, 2)], "doc_id BIGINT, quality INT, toxic INT") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        pairs = [{(r.doc_id, r.code) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("cv_predict", "cv_nested")]
    finally:
        spark.conf.unset(key)
    assert pairs[0] == pairs[1] and len(pairs[0]) > 50
