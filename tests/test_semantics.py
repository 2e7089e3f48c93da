"""Hand cases for rules that are easy to get wrong."""
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.operators import learn, mining, orchestrate as orc, scoring
from labelflow.session import scratch_path
from labelflow.sources import contract

PRED = "doc_id BIGINT, code INT, score DOUBLE, predicted BOOLEAN"


def test_label_space_has_no_cap(spark):
    docs = spark.createDataFrame([(1,)], "doc_id BIGINT")
    space = spark.range(100_001).select(F.col("id").cast("int").alias("code"))
    scores = spark.createDataFrame([(1, 100_000, 0.9, True)], PRED)
    rows = contract.dense_contract(scores, docs, space, "m")
    assert rows.count() == 100_001 and rows.where("predicted").count() == 1


def _lines(*lines):
    path = os.path.join(tempfile.mkdtemp(), "d.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(lines))
    return path


def test_reader_takes_string_ids_and_fails_on_broken_lines(spark):
    path = _lines(json.dumps({"doc_id": "akte-17", "text": "t", "codes": ["a", "b"]}), "",
                  json.dumps({"doc_id": "akte-18", "text": "u", "codes": "c"}))
    rows = {r.doc_id: r.codes for r in contract.read_deeds(spark, path, "string", "string").collect()}
    assert rows == {"akte-17": ["a", "b"], "akte-18": ["c"]}
    for bad in ('{"doc_id": "1", "text": ', '{"text": "no id"}', '{"doc_id": "akte", "text": "t"}'):
        with pytest.raises(Exception):
            contract.read_deeds(spark, _lines('{"doc_id": "1", "text": "t"}', bad)).collect()


def test_strict_modes_raise(spark):
    space = spark.createDataFrame([(1,), (2,)], "code INT")
    scores = spark.createDataFrame([(1, 1, 0.9, True)], PRED)
    ids = spark.createDataFrame([(1,), (2,)], "doc_id BIGINT")
    assert contract.align(scores, ids, space)[0].count() == 4
    with pytest.raises(ValueError):
        contract.align(scores, ids, space, strict=True)
    th = spark.createDataFrame([(1, 0.4)], "code INT, threshold DOUBLE")
    assert {r.code: r.threshold for r in contract.threshold_lookup(space, th).collect()} == {1: 0.4, 2: 0.5}
    with pytest.raises(ValueError):
        contract.threshold_lookup(space, th, strict=True)


def test_sweep_keeps_a_method_without_an_auto_document(spark):
    preds = spark.createDataFrame([("a", 1, 1, 0.9, True), ("b", 1, 1, 0.01, True)],
                                  "method STRING, doc_id BIGINT, code INT, score DOUBLE, predicted BOOLEAN")
    truth = spark.createDataFrame([(1, 2)], "doc_id BIGINT, code INT")
    docs = spark.createDataFrame([(1,)], "doc_id BIGINT")
    n = spark.createDataFrame([(2,)], "n_codes BIGINT")
    sweep = orc.precision_coverage(preds, truth, docs, n)
    assert {r.method: r["count"] for r in sweep.groupBy("method").count().collect()} == {"a": 80, "b": 80}
    assert {r.method: r.auto_threshold for r in orc.operating_point(sweep).collect()} == {"a": 0.5, "b": 0.5}


def test_mutex_folds_pairs_in_order(spark):
    preds = spark.createDataFrame([(1, 10, 0.9, True), (1, 20, 0.8, True), (1, 30, 0.7, True),
                                   (2, 10, 0.5, True), (2, 20, 0.5, True), (3, 20, 0.4, True)], PRED)
    ref = spark.createDataFrame([(1, 10, 0.1), (1, 20, 0.6), (1, 30, 0.5), (2, 10, 0.3), (2, 20, 0.3)],
                                "doc_id BIGINT, code INT, score DOUBLE")
    out = scoring.mutex(preds, ref, [(10, 20), (20, 30), (10, 30)])
    kept = {(r.doc_id, r.code) for r in out.where("predicted").collect()}
    assert kept == {(1, 20), (2, 10), (3, 20)} and out.count() == 6


def test_tiebreak_winner_is_in_the_space(spark):
    preds = spark.createDataFrame([(1, 20, 0.9, True), (2, 40, 0.9, True), (3, 5, 0.9, True)], PRED)
    texts = spark.createDataFrame([(1, "das für"), (2, "nothing"), (3, "für")], "doc_id BIGINT, text STRING")
    rules = [("für", 30), ("das", 40)]
    run = lambda codes: {(r.doc_id, r.code) for r in scoring.tiebreak(
        preds, texts, (20, 30, 40), rules, 20, spark.createDataFrame([(c,) for c in codes], "code INT")).where("predicted").collect()}
    assert run([20, 30, 40]) == {(1, 30), (2, 20), (3, 5)}
    assert run([20, 40]) == {(1, 40), (2, 20), (3, 5)}
    assert run([30, 40]) == {(1, 30), (2, 40), (3, 5)}


def test_candidates_listed_twice_count_apart(spark):
    cands = spark.createDataFrame([(1, "deed of sale", None), (1, "deed of sale", None), (1, "(sale)", None)],
                                  "code INT, phrase STRING, name STRING")
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["a deed of sale", "deed of sale_x", "deed of sale (sale)", "the (sale)", "(sale) deed of sale"])], "doc_id BIGINT, title STRING")
    truth = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id BIGINT, code INT")
    got = sorted((r.phrase, r.hits_total) for r in mining.validate_candidates(cands, titles, truth).collect())
    assert got == [("(sale)", 3), ("deed of sale", 3), ("deed of sale", 3)]


def test_times_sign_is_no_letter(spark):
    d = spark.createDataFrame([("×abc abc× dé÷fgh",)], "text STRING")
    assert d.select(tx.mining_tokens(F.col("text"))).first()[0] == ["abc", "abc", "fgh"]


def test_reloaded_scorer_scores_new_documents(spark):
    docs = spark.createDataFrame([(i, ("red blue " if i % 2 else "green yellow ") * 20) for i in range(20)], "doc_id BIGINT, text STRING")
    truth = spark.createDataFrame([(i, 1 + i % 2) for i in range(20)], "doc_id BIGINT, code INT")
    cfg = learn.ChunkConfig(8, 6)
    chunks = learn.chunk_docs(docs, cfg)
    idf = learn.fit_idf(learn.chunk_tf(chunks, 256))
    weights = spark.createDataFrame([(1, 1.0), (2, 1.0)], "code INT, pos_weight DOUBLE")
    head = learn.fit_head(learn.chunk_features(chunks, idf, 256), truth, weights, [1, 2])
    scorer = learn.Scorer(cfg, 256, "mean", idf, head, {1: 0.4, 2: 0.99})
    root = scratch_path(spark, "scorer")
    scorer.save(spark, root)
    new = spark.createDataFrame([(100, "red red blue"), (101, "green and yellow"), (102, "")], "doc_id BIGINT, text STRING")
    loaded = learn.Scorer.load(spark, root)
    assert loaded.thresholds == scorer.thresholds
    a, b = ({(r.doc_id, r.code): round(r.score, 9) for r in s.score(new).collect()} for s in (scorer, loaded))
    assert {r.predicted for r in loaded.predict(new).where("code = 2").collect()} == {False}
    assert a == b and len(a) == 6
    assert a[100, 2] > 0.5 > a[100, 1] and a[101, 1] > 0.5 > a[101, 2]


@pytest.mark.parametrize("how", ["mean", "max"])
def test_features_hold_no_zeros(spark, how):
    """A document's vector has its own dimensions only, over chunks, repeated and null ids."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "a a"), (3, "f"), (None, "b"), (None, "c")], "doc_id BIGINT, text STRING")
    chunks = learn.chunk_docs(docs, learn.ChunkConfig(2, 2))
    idf = learn.fit_idf(learn.chunk_tf(chunks, 64))
    want = {}
    for r in idf.transform(learn.chunk_tf(chunks, 64)).collect():
        want.setdefault(r.doc_id, []).append((r.n_tokens, r.vec.toArray()))
    got = {r.doc_id: r.x for r in learn.chunk_features(chunks, idf, 64, how).collect()}
    assert set(got) == set(want) == {1, 2, 3, None} and len(got[1].dims) <= 5 and len(got[2].dims) == 0
    for k, rows in want.items():
        full = np.average([v for _, v in rows], 0, [w for w, _ in rows]) if how == "mean" else np.max([v for _, v in rows], 0)
        x = np.zeros(64)
        x[got[k].dims] = got[k]["values"]
        assert np.allclose(x, full) and got[k].size == 64


@pytest.mark.parametrize("loss", ["bce", "focal"])
def test_loss_slope_is_the_derivative(loss):
    z, y, w, h = np.linspace(-6, 6, 25), np.arange(25) % 2 == 1, 3.0, 1e-5

    def value(z):
        p = 1 / (1 + np.exp(-z))
        pt = np.where(y, p, 1 - p)
        return -np.where(y, w, 1.0) * np.log(pt) if loss == "bce" else -(1 - pt) ** 2 * np.log(pt)
    assert np.allclose(learn.loss_slope(z, y, w, loss, 2.0), (value(z + h) - value(z - h)) / (2 * h), atol=1e-6)


def test_jobs_do_not_grow_with_the_codes(spark):
    x = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "doc_id BIGINT, x ARRAY<DOUBLE>")
    none = spark.createDataFrame([], "code INT, pos_weight DOUBLE")

    def jobs(codes):
        truth = spark.createDataFrame([(i, c) for i in range(30) for c in codes if (i + c) % 3 == 0], "doc_id BIGINT, code INT")
        sc = spark.sparkContext
        sc.setJobGroup(f"head-{len(codes)}", "", False)
        learn.fit_head(x, truth, none, codes, learn.TrainConfig(2))
        n = len(sc.statusTracker().getJobIdsForGroup(f"head-{len(codes)}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n
    assert jobs([1]) == jobs(list(range(1, 21)))


def test_cls_takes_the_largest_of_the_first_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 5.0], 3), (1, 1, [2.0, 4.0], 3)], "doc_id BIGINT, chunk_no INT, embedding ARRAY<DOUBLE>, n_tokens INT")
    assert sorted((r.dim, r.value) for r in learn.pool(v, "cls").collect()) == [(0, 2.0), (1, 5.0)]


def _mining_rows(spark):
    texts = [(1, "alpha beta alpha"), (2, "beta gamma ... alpha beta"), (3, "delta"), (3, "alpha beta"), (None, "alpha beta"), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    truth = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 8), (9, 8), (None, 7)], "doc_id BIGINT, code INT")
    return docs, truth, spark.createDataFrame([(7,), (8,)], "code INT")


def test_term_counts_by_hand(spark):
    """A repeated id is one document, no n-gram runs from one of its texts into the next."""
    docs, truth, codes = _mining_rows(spark)
    got = {r.term: (r.df, r.tf_sum, sorted((tuple(x.codes), x.value) for x in r.by)) for r in mining.term_counts(docs, truth, codes, ()).collect()}
    assert got["alpha beta"] == (4, 4, [((), 1.0), ((7,), 1.0), ((7, 8), 1.0), ((8,), 1.0)])
    assert got["alpha"][:2] == (4, 5) and got["delta"] == (1, 1, [((8,), 1.0)]) and "delta alpha" not in got
    assert set(got) == {"alpha", "beta", "gamma", "delta", "alpha beta", "beta alpha", "beta gamma", "gamma alpha",
                        "alpha beta alpha", "beta gamma alpha", "gamma alpha beta"}


def test_best_terms_keep_the_order_of_ties(spark):
    """A task's choice keeps, of equal scores, the first terms."""
    docs = spark.createDataFrame([(i, " ".join(f"wor{c}" for c in "zyxwvu") if i < 3 else "other") for i in range(6)], "doc_id BIGINT, text STRING")
    truth = spark.createDataFrame([(0, 7), (1, 7), (2, 7)], "doc_id BIGINT, code INT")
    codes, n = spark.createDataFrame([(7,)], "code INT"), mining.corpus_size(docs)
    vocab = mining.vocabulary(mining.term_counts(docs, truth, codes, ()), n)
    chi2 = mining.mine_chi2(docs, vocab, truth, codes, n, k=2)
    assert sorted((r["rank"], r.term) for r in chi2.collect()) == [(1, "woru"), (2, "worv")]
    tfidf = mining.mine_tfidf(docs, vocab, truth, codes, n, k=2, stopwords=())
    assert sorted((r["rank"], r.term) for r in tfidf.collect()) == [(1, "woru"), (2, "worv")]


def test_mining_shuffles_packed_terms(spark):
    """Terms cross the network packed, and best terms are chosen before any shuffle of scores."""
    docs, truth, codes = _mining_rows(spark)
    plan = mining.term_counts(docs, truth, codes, ())._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(term" not in plan
