"""Metrics against dense numpy, sources and contract checks."""
import os
import tempfile

import numpy as np
import pytest

from labelflow.operators import calibrate, metrics, orchestrate
from labelflow.sources import contract


def test_metrics_equal_dense(spark):
    rng = np.random.default_rng(1)
    y = rng.random((30, 5)) < 0.3
    p = rng.random((30, 5)) < 0.4
    preds = [("m", d, c, bool(p[d, c])) for d in range(30) for c in range(5)]
    truth = [(d, c) for d in range(30) for c in range(5) if y[d, c]]
    pr = spark.createDataFrame(preds, "method STRING, doc_id BIGINT, code INT, predicted BOOLEAN")
    tr = spark.createDataFrame(truth, "doc_id BIGINT, code INT")
    docs = spark.range(30).withColumnRenamed("id", "doc_id")
    space = spark.createDataFrame([(c,) for c in range(5)], "code INT")
    m = metrics.evaluate(pr, tr, docs, space, digits=12).first()
    tp = (p & y).sum(); fp = (p & ~y).sum(); fn = (~p & y).sum()
    assert m.micro_f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    f1s = [2 * (p[:, c] & y[:, c]).sum() / max(2 * (p[:, c] & y[:, c]).sum() + (p[:, c] & ~y[:, c]).sum()
                                               + (~p[:, c] & y[:, c]).sum(), 1) for c in range(5) if y[:, c].any()]
    assert m.macro_f1 == pytest.approx(np.mean(f1s))


def test_jsonl_label_shapes(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        fh.write('{"doc_id": "1", "text": "a", "codes": 5}\n\n{"doc_id": "2", "text": "b", "codes": null}\n'
                 '{"doc_id": "3", "text": "c", "codes": []}\n{"doc_id": "4", "text": "d", "codes": [7, 8]}\n')
    rows = {r.doc_id: r.codes for r in contract.read_deeds(spark, d).collect()}
    assert rows == {1: [5], 2: [], 3: [], 4: [7, 8]}


def test_freeze_guard(spark):
    path = os.path.join(tempfile.mkdtemp(), "space")
    df = spark.createDataFrame([(1,)], "code INT")
    contract.freeze(df, path)
    with pytest.raises(Exception):
        contract.freeze(df, path)


def test_confidence_edges(spark):
    p = spark.createDataFrame([("r", 1, 1, 0.9, True), ("r", 1, 2, 0.8, True),     # all predicted
                               ("r", 2, 1, 0.1, False), ("r", 2, 2, 0.2, False)],  # nothing predicted
                              "method STRING, doc_id BIGINT, code INT, score DOUBLE, predicted BOOLEAN")
    f = {r.doc_id: r for r in orchestrate.escalate_flag(orchestrate.confidence(p), 0.5, 0.1).collect()}
    assert f[1].max_rej is None and f[1].escalated is False
    assert f[2].min_pred is None and f[2].escalated is True


def test_reliability_bin_edge(spark):
    c = spark.createDataFrame([("m", 0, 0, 0.1, 1.0)], "method STRING, doc_id BIGINT, code INT, score DOUBLE, y DOUBLE")
    assert calibrate.reliability(c).first().bin == 0


def test_chunks_short_and_empty(spark):
    from labelflow.operators import learn
    d = spark.createDataFrame([(0, ""), (1, "a b c")], "doc_id BIGINT, text STRING")
    c = {(r.doc_id, r.chunk_no): r.tokens for r in learn.chunk_docs(d, learn.ChunkConfig(4, 2, 8)).collect()}
    # empty text: one empty chunk; the last chunk may lie wholly inside the one before
    assert c == {(0, 0): [], (1, 0): ["a", "b", "c"], (1, 1): ["c"]}


def test_table_sinks_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "code INT, f1 DOUBLE")
    for fmt in ("csv", "json", "parquet"):
        path = os.path.join(d, fmt)
        contract.write_table(df, path, fmt)
        reader = {"csv": lambda p: spark.read.option("header", True).schema("code INT, f1 DOUBLE").csv(p),
                  "json": lambda p: spark.read.schema("code INT, f1 DOUBLE").json(p),
                  "parquet": spark.read.parquet}[fmt]
        assert sorted(tuple(r) for r in reader(path).collect()) == [(1, 0.5), (2, 0.25)]


def test_config_source_flattens_loss(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.json"), "w") as fh:
        fh.write('{"pooling": "mean", "content_size": 510, "stride": 460, "max_chunks": 8,\n'
                 ' "loss": {"type": "focal", "gamma": 2.0}}')
    r = contract.read_configs(spark, d).first()
    assert (r.run, r.loss_type, r.loss_gamma, r.max_chunks) == ("a", "focal", 2.0, 8)


def test_config_written_by_spark(spark):
    root = os.path.join(tempfile.mkdtemp(), "cfg")
    contract.write_config(spark, {"pooling": "max", "max_chunks": 3, "loss": {"type": "bce", "gamma": 1.0}}, root, "v1")
    r = contract.read_configs(spark, root).first()
    assert (r.run, r.pooling, r.max_chunks, r.loss_type) == ("v1", "max", 3, "bce")


def test_feature_summary_equals_pandas(spark):
    """All statistics of all features, with nulls, ties, one value, and a feature without any."""
    import pandas as pd
    rng = np.random.default_rng(4)
    rows = [(m, i, None if i % 7 == 0 else float(np.round(rng.normal(50, 90), 1)), int(rng.integers(0, 4)), None)
            for m in ("a", "b") for i in range(200)] + [("c", 0, 2.5, 1, None)]
    feats = spark.createDataFrame(rows, "method STRING, doc_id INT, x DOUBLE, n INT, nothing DOUBLE")
    got = {(r.method, r.feature): r.asDict() for r in orchestrate.feature_summary(feats, ["x", "n", "nothing"]).collect()}
    want = pd.DataFrame(rows, columns=["method", "doc_id", "x", "n", "nothing"])
    assert set(got) == {(m, f) for m in "abc" for f in ("x", "n")}
    for (m, f), r in got.items():
        d = want[want.method == m][f].astype(float).describe()
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
            assert r[ours] is None and np.isnan(d[theirs]) or abs(r[ours] - d[theirs]) < 1e-9, (m, f, ours)
    assert orchestrate.feature_summary(feats.limit(0), ["x"]).collect() == []
    q = {r.method: r.q50 for r in orchestrate.exact_quantiles(feats, ["method"], "x").collect()}
    assert abs(q["a"] - want[want.method == "a"].x.median()) < 1e-9


def test_named_methods_equal_looked_up_ones(spark):
    preds = spark.createDataFrame([("a", 1, 5, True), ("a", 2, 6, True), ("b", 1, 6, False)],
                                  "method STRING, doc_id INT, code INT, predicted BOOLEAN")
    truth = spark.createDataFrame([(1, 5), (2, 5)], "doc_id INT, code INT")
    docs, space = spark.createDataFrame([(1,), (2,)], "doc_id INT"), spark.createDataFrame([(5,), (6,)], "code INT")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for fn in (lambda **k: metrics.counts(preds, truth, docs, space, **k),
               lambda **k: metrics.subset_accuracy(preds, truth, docs, space, **k),
               lambda **k: metrics.codes_per_doc(preds, docs, **k)):
        assert rows(fn()) == rows(fn(methods=["a", "b"]))
    extra = {(r.method, r.code): (r.tp, r.fp, r.fn) for r in metrics.counts(preds, truth, docs, space, ["a", "z"]).collect()}
    assert extra == {("a", 5): (1, 0, 1), ("a", 6): (0, 1, 0), ("z", 5): (0, 0, 2), ("z", 6): (0, 0, 0)}


def test_contract_tasks_do_not_grow_with_the_documents(spark, monkeypatch):
    """Grid and checks are dealt by size; repeated documents, null ids and unknown
    codes count as before."""
    from labelflow.sources import contract
    monkeypatch.setattr(contract, "CELLS_PER_TASK", 2, raising=False)
    docs = spark.createDataFrame([(i,) for i in [*range(60), 7]], "doc_id long")
    space = spark.createDataFrame([(1,), (2,)], "code int")
    scores = spark.createDataFrame([(1, 1, 0.5, True), (1, 1, 0.25, False), (2, 9, 0.5, True)],
                                   "doc_id long, code int, score double, predicted boolean")
    dense = contract.dense_contract(scores, docs, space, "m")
    n = max(61, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert f", {n})" in (plan := dense._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan
    rows = sorted((r.doc_id, r.code, r.score) for r in dense.collect())
    assert len(rows) == 123 and [r for r in rows if r[2]] == [(1, 1, 0.25), (1, 1, 0.5)]
    odd = spark.createDataFrame([(None, 1, 0.5, True, "m"), (3, 8, 0.5, True, "m"), (99, 1, 2.0, True, "m"), (4, 1, None, True, "m"),
                                 (5, None, 0.5, True, "m")], "doc_id long, code int, score float, predicted boolean, method string")
    got = contract.contract_violations(dense.unionByName(odd), docs, space)
    assert "hashpartitioning(doc_id" in got._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    # document 7 stands twice, so its rows count for each of the two
    assert [tuple(r) for r in got.collect()] == [("m", 132, 1, 3, 6, 0, 2)]
