"""Packed mining: the (document, term) counts of ``term_index``, TF-IDF and its sums by code,
against plain loops over the same rows."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelflow.operators import mining


def _grams(words):
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    words = ["alpha", "béta", "gamma", "delta", "épsi", "zeta", "eta's", "größe", "the"]
    texts = [(i, " ".join(r.choices(words, k=r.choice([1, 4, 30])))) for i in range(60)]
    texts += [(3, "alpha béta"), (7, None), (61, None), (62, ""), (63, "a 12"), (None, "alpha gamma"), (None, "gamma")]
    truth = [(i, c) for i in range(60) for c in (1, 2, 3) if r.random() < .4] + [(None, 1), (99, 2), (5, 3), (5, 3)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING").repartition(5)
    return (docs, spark.createDataFrame(truth, "doc_id BIGINT, code INT"), spark.createDataFrame([(1,), (2,), (3,)], "code INT"),
            texts, truth)


def _plain(texts, n_docs, min_df=2):
    """{doc_id: {term: w}} and {term: df}, a repeated id being one document."""
    tf = defaultdict(Counter)
    for i, t in texts:
        toks = [] if not t else [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) > 2 and w.isalpha()]
        tf[i].update(_grams(toks))
    df = Counter(t for c in tf.values() for t in c)
    known = {t for t in df if min_df <= df[t] <= .5 * n_docs}
    out = {}
    for i, c in tf.items():
        w = {t: n * (math.log((1 + n_docs) / (1 + df[t])) + 1) for t, n in c.items() if t in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / norm for t, x in w.items()}
    return out, df


def test_weights_by_hand(spark, rows):
    docs, truth, codes, texts, _ = rows
    index, n = mining.term_index(docs, truth, codes, ()), mining.corpus_size(docs)
    vocab = mining.vocabulary(index.terms, n)
    want, df = _plain(texts, len(texts))
    got = defaultdict(dict)
    for r in mining.tfidf(mining.restrict_to_vocab(index, vocab), n).join(vocab, "term_id").collect():
        assert r.term not in got[r.doc_id] and r.df == df[r.term]
        got[r.doc_id][r.term] = r.w
    assert None in got and set(got) == {i for i in want if want[i]}
    for i in got:
        assert got[i] == pytest.approx(want[i], rel=1e-12)
    some = vocab.where("term LIKE 'g%'")     # any part of the vocabulary will do
    kept = mining.tfidf(mining.restrict_to_vocab(index, some), n).select("doc_id", "term_id").join(some, "term_id").collect()
    assert sorted((str(r.doc_id), r.term) for r in kept) == sorted((str(i), t) for i in want for t in want[i] if t[0] == "g")


def test_terms_of_the_index_are_the_counts(spark, rows):
    docs, truth, codes, _, _ = rows
    flat = lambda df: sorted((r.term, r.df, r.tf_sum, sorted((tuple(x.codes), x.value) for x in r.by)) for r in df.collect())
    counts = mining.term_counts(docs, truth, codes, ())
    index = mining.term_index(docs, truth, codes, ())
    assert flat(index.terms) == flat(counts.where("df >= 2")) and index.terms.select("term_id").distinct().count() == index.terms.count()


def test_best_terms_by_hand(spark, rows):
    """With the index and without it: the same terms as from sums in plain loops."""
    docs, truth, codes, texts, pairs = rows
    n, index = mining.corpus_size(docs), mining.term_index(docs, truth, codes, ())
    vocab = mining.vocabulary(index.terms, n)
    got = [sorted((r.code, r.term, r.score) for r in mining.mine_tfidf(docs, v, truth, codes, n, 400, (), index=x).collect())
           for v, x in ((vocab, index), (mining.vocabulary(mining.term_counts(docs, truth, codes, ()), n), None))]
    w, _ = _plain(texts, len(texts))
    ids, want = {i for i, _ in texts}, []
    for c in (1, 2, 3):
        pos = {i for i, k in pairs if k == c and i in ids and i is not None}
        for t in {t for x in w.values() for t in x}:
            s, tot = (sum(w[i].get(t, 0) for i in k) for k in (pos, w))
            score = s / len(pos) - (tot - s) / (len(texts) - len(pos))
            if score > 1e-11:
                want.append((c, t, score))
    for g in got:
        assert [x[:2] for x in g] == [x[:2] for x in sorted(want)]
        assert [x[2] for x in g] == pytest.approx([x[2] for x in sorted(want)], abs=2e-12)


def test_tfidf_shuffles_no_terms(spark, rows):
    """Neither the texts of terms nor single (document, term) rows cross the network."""
    docs, truth, codes, _, _ = rows
    index, n = mining.term_index(docs, truth, codes, ()), mining.corpus_size(docs)
    x = mining.restrict_to_vocab(index, mining.vocabulary(index.terms, n))
    for df in (mining.tfidf(x, n), mining._set_sums(x, n, index.parts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(part" in plan and "hashpartitioning(piece" in plan
        assert not any(f"hashpartitioning({c}" in plan for c in ("term", "doc_id"))


def test_pieces_hold_the_rows_cut(monkeypatch):
    """Counting works on batches cut between rows, whose arrays begin within others."""
    monkeypatch.setattr(mining, "PIECE_TOKENS", 20)
    r = random.Random(1)
    lists = [[" ".join(r.choices(["été", "büro", "word", "ça"], k=k)) for k in r.choices([0, 1, 9], k=r.choice([1, 2]))] for _ in range(50)]
    whole = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["_tokens"])
    got, at = [], 0
    cut = [*mining._pieces(iter([whole]))]
    assert len(cut) > 5
    for b in cut:
        for texts, hashes, gram, row, tf in mining._gram_counts(b.column("_tokens"), 3):
            got += zip((row + at).tolist(), texts.take(pa.array(gram)).to_pylist(), tf.tolist())
            assert len(set(hashes.tolist())) == len(texts)
        at += len(b)
    assert sorted(got) == sorted((i, t, n) for i, x in enumerate(lists) for t, n in Counter(g for y in x for g in _grams(y.split())).items())


def test_numbers_are_packed_and_back():
    x, y = np.array([0, 1, 255, 256, 1 << 30]), np.array([], np.int64)
    assert [c.tolist() for c in mining._columns(mining._numbers(x, y, x[:2]), 5, 0, 2)] == [x.tolist(), [], [0, 1]]
    assert mining._ranges(np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]


def test_texts_are_cut_once(spark, monkeypatch):
    """The vocabulary, chi-squared and TF-IDF share one pass over the texts, in the hybrid's variants, too."""
    from labelflow.plans import q_hybrid, q_mining
    from labelflow.session import materialize
    calls, cut = [], mining.coded_tokens
    monkeypatch.setattr(mining, "coded_tokens", lambda *a: calls.append(1) or cut(*a))
    m = q_mining.MinedFixture(spark, "/root/testdata/sf0.001")
    assert m.merged.count() > 0 and len(calls) == 1
    calls.clear()
    patterns = q_hybrid._fixture_patterns(m.fx, m.truth)(m.codes, materialize(m.docs.limit(40)))
    assert patterns.where("source LIKE 'data-derived%'").count() > 0 and len(calls) == 1
