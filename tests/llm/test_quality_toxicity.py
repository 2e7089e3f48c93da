import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from labelflow.llm import quality, toxicity
from labelflow.llm.queries import QUERIES
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("key,label,least,cut", [("op1_quality", "quality", 0.97, 0.7), ("op10_toxicity", "toxic", 0.95, 0.3)])
def test_held_out_accuracy(spark, key, label, least, cut):
    rows = QUERIES[key](spark, SF).toPandas()
    assert list(rows.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert len(rows) == table(spark, SF, "documents").count() and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(held)).all() and ((rows.score >= cut) == (rows.predicted == 1)).all()
    y = table(spark, SF, "labels").toPandas().set_index("doc_id")[label]
    own = rows[rows.held_out & rows.doc_id.isin(y.index)]
    right = own.predicted == own.doc_id.map(y)
    assert right.mean() >= least
    positive = own[own.doc_id.map(y) == 1]
    assert positive.predicted.mean() >= 0.8


def test_tree_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit_trees(x, y, n_trees=20)
    z = []
    for r in x:
        total = m.base
        for t in range(len(m.feature)):
            node = 0
            for _ in range(m.depth):
                node = 2 * node + (2 if r[m.feature[t, node]] > m.threshold[t, node] else 1)
            total += m.leaf[t, node - (2 ** m.depth - 1)]
        z.append(total)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.array(z))))
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_empty_tables(spark, odd_docs, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (5, 1), (6, 0), (None, 1)], f"doc_id long, {label} int")
    model = module.fit(odd_docs, labels)
    rows = module.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = module.fit(odd_docs.limit(0), labels.limit(0))
    assert module.score(odd_docs.limit(0), none).count() == 0
    assert {r.score for r in module.score(odd_docs, none).collect()} == {0.5}
    one = module.fit(odd_docs, spark.createDataFrame([(1, 1), (5, 1)], f"doc_id long, {label} int"))
    assert min(r.score for r in module.score(odd_docs, one).collect()) > 0.99


def test_kernel_equals_enumeration():
    def brute(s, t):
        def weights(x):
            out = {}
            for c in itertools.combinations(range(len(x)), toxicity.ORDER):
                key = "".join(x[i] for i in c)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
            return out
        a, b = weights(s), weights(t)
        return sum(a[k] * b.get(k, 0) for k in a)

    rng = random.Random(1)
    for _ in range(40):
        s, t = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(2))
        got = toxicity.raw_kernel(toxicity._codes([s]), toxicity._codes([t]))[0]
        assert got == pytest.approx(brute(s, t), rel=1e-4, abs=1e-6)


def test_gaps_and_inserted_letters_are_found():
    rng = random.Random(2)
    good = [f"{rng.choice('bdfgklmn')}{rng.choice('aeu')}{rng.choice('rstvz')}{rng.choice('aeu')}" for _ in range(300)]
    texts, y = [], []
    for i in range(400):
        words = [rng.choice(good) for _ in range(30)]
        if i % 8 == 0:
            words[rng.randrange(30)] = rng.choice(["horrible", "dimwit"])
        texts.append(" ".join(words))
        y.append(int(i % 8 == 0))
    m = toxicity.fit_machine(texts, np.array(y))
    s = toxicity.Scorer(m)
    told = ["what a dimwit", "you d-i-m-w-i-t", "so h o r r i b l e of you", "a dimxwit!", "HORRIBLE"]
    clean = ["mera bura", "", None, "a b", "12345 67890", " ".join(good[:50])]
    p = m.probability(s.decisions(pa.array(told + clean)))
    assert (p[:len(told)] >= toxicity.THRESHOLD).all() and (p[len(told):] < toxicity.THRESHOLD).all()


def test_two_letters_split_and_stretched_words_are_found():
    rng = random.Random(2)
    good = [f"{rng.choice('bdfgklmn')}{rng.choice('aeu')}{rng.choice('rstvz')}{rng.choice('aeu')}" for _ in range(300)]
    texts, y = [], []
    for i in range(400):
        words = [rng.choice(good) for _ in range(30)]
        if i % 8 == 0:
            words[rng.randrange(30)] = rng.choice(["horrible", "idiot"])
        texts.append(" ".join(words))
        y.append(int(i % 8 == 0))
    m = toxicity.fit_machine(texts, np.array(y))
    told = ["idxioyt", "ixdioyt", "an id io t!", "iiiiiiiiiiiidiot", "ho rr ib le", "horxribqle"]
    clean = ["mera bura", " ".join(good[:50]), "of it is so", "x y z", "0123456789abcdef" * 4, "aaaaaaaaaaaaaaa"]
    p = m.probability(toxicity.Scorer(m).decisions(pa.array(told + clean)))
    assert (p[:len(told)] >= toxicity.THRESHOLD).all(), p
    assert (p[len(told):] < toxicity.THRESHOLD).all(), p


@pytest.mark.parametrize("most", [toxicity.MAX_LANDMARKS, 120])
def test_more_toxic_words_than_landmarks_are_all_learned(most):
    rng = random.Random(8)

    def word(consonants):
        return "".join(rng.choice(consonants) + rng.choice("aeiou") for _ in range(4))

    bad = sorted({word("kpqtvxz") for _ in range(90)})
    good = sorted({word("bdfglmnrs") for _ in range(400)})
    texts, y = [], []
    for i in range(len(bad) * 40):
        words = [rng.choice(good) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = bad[i // 4 % len(bad)]
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    m = toxicity.fit_machine(texts, np.array(y), landmarks=24, max_landmarks=most)
    p = m.probability(toxicity.Scorer(m).decisions(pa.array(bad)))
    assert len(bad) > 80 and (p >= toxicity.THRESHOLD).all()
    q = m.probability(toxicity.Scorer(m).decisions(pa.array(good)))
    assert (q < toxicity.THRESHOLD).all()


def test_triple_table_equals_pairwise_kernel():
    rng = random.Random(6)
    marks = ["dimwit", "idiot", "loser", "été"]
    weights = np.array([1.5, 0.7, -0.4, 0.9])
    words = ["".join(rng.choice("dimwtolserxé") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = toxicity.Machine(marks, 3, weights, -0.3).decisions(words)
    assert np.allclose(got, toxicity.kernel(words, marks) @ weights - 0.3, atol=1e-4)


def test_scorer_equals_words_of():
    m = toxicity.Machine(["dimwit"], 1, np.array([2.0]), -1.0, 1.0, 0.0)
    rng = random.Random(3)
    texts = ["".join(rng.choice("dim wt-.D\nW ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = toxicity.Scorer(m).decisions(pa.array(texts))
    for t, g in zip(texts, got):
        words = toxicity.words_of(re.sub(r"[\t\n\x0b\x0c\r]", " ", t), m.join)
        assert g == pytest.approx(max(m.decisions(words), default=m.bias)), t


def test_plain_pieces_are_learned_together(monkeypatch):
    """Only pieces with repeated letters, many letters or several words go one by one."""
    seen, views = [], toxicity.views
    monkeypatch.setattr(toxicity, "views", lambda w: seen.append(w) or views(w))
    m = toxicity.Machine(["^dimwit", "^σοςσ"], 2, np.array([2.0, 1.0]), -1.0, 1.0, 0.0)
    odd = ["diiimwit", "dim\u00a0wit", "\u00a0-dimwit", "dimwit\u2003xy", "dimwit" * 9, "a\u2003-", "\u2003\u2003"]
    plain = ["Dimwit", "dim-wit!", "__", "", "di", "\u03a3\u039f\u03a3\u03a3", "\u03a3\u039f\u03a3", "\u0130dimwit", "d\u200bimwit", "aa", "ab"]
    s = toxicity.Scorer(m)
    got = s.decisions(pa.array([f"{p} x{i}" for i, p in enumerate(odd + plain)]))
    assert len(seen) <= 2 * len(odd)
    for i, p in enumerate(odd + plain):
        assert got[i] == pytest.approx(max(m.decisions(toxicity.words_of(f"{p} x{i}", m.join)), default=m.bias)), p
    assert s.decisions(pa.array(odd + plain))[0] == max(m.decisions(views("diiimwit")))
