import math
import random
import re
from collections import Counter, defaultdict

import pytest

from labelflow.llm import ranked_search as rs
from labelflow.llm.queries import QUERIES
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k=20):
    vec = [(i, t) for i, t in ((i, Counter(terms(x))) for i, x in docs) if t]
    n, total = len(vec), sum(sum(t.values()) for _, t in vec)
    df = Counter(w for _, t in vec for w in t)
    out = []
    for no, (item, text) in enumerate(items):
        scores = []
        for i, t in vec:
            m = 75 + 25 * sum(t.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 12 * m)) * q
                    for w, q in Counter(terms(text)).items() if w in t)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if there else None, -s) for r, (s, there, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(docs, items, k=20):
    return sorted(map(tuple, rs.search(docs, items, k).collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents", "doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark", "item_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_ranked_search"](spark, SF).collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("bounds", [(1, 1), (40, 7), (1 << 20, 1 << 14)])
def test_ties_copies_and_small_tries(spark, tables, monkeypatch, bounds):
    monkeypatch.setattr(rs, "TREE_POSTINGS", bounds[0])
    monkeypatch.setattr(rs, "TREE_DOCS", bounds[1])
    for name in ("SEED", "GATHER"):
        monkeypatch.setattr(rs, name, 3)
    monkeypatch.setattr(rs, "BLOCK_TERMS", 40)
    rng = random.Random(bounds[1])
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ünï", "A1", "x_y", "ÉÉ"]
    docs = [(i if i % 29 else None, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 10, 30])))) for i in range(200)]
    docs += [(300 + i % 50, "w1 w2 w3 same copy") for i in range(100)] + [(1, None), (2, ""), (3, " ,.\n")]
    items = [(f"i{i % 9}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20])))) for i in range(12)]
    items += [("gone", "nowhere"), ("none", None), (None, "copy copy w2"), ("blank", "")]
    spread = tables([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, score int").repartition(4)
    for k in (1, 20):
        assert run(spread, tables([(*x, 7) for x in items], "item_id string, text string, rank int"), k) == brute(docs, items, k)


def test_odd_and_empty_tables(spark, odd_docs, tables):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [("a", "word1 tail3 A five"), ("b", "text\x00here \U0001f600")]
    bench = tables(items, "item_id string, text string")
    assert run(odd_docs, bench) == brute(docs, items)
    assert rs.search(odd_docs.limit(0), bench).count() == 0 and rs.search(odd_docs, bench.limit(0)).count() == 0


def test_the_walk_skips_what_cannot_reach(spark, tables, monkeypatch):
    """Fewer documents are scored than hold a term."""
    scored = []
    plain = rs.Tree._scores
    monkeypatch.setattr(rs.Tree, "_scores", lambda self, docs, dense: scored.append(len(docs)) or plain(self, docs, dense))
    rng = random.Random(5)
    import numpy as np
    rows = [sorted(rng.sample(range(60), rng.randint(1, 30))) for _ in range(3000)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree = rs.Tree(np.arange(3000), np.full(3000, 100), np.concatenate(rows).astype(np.int64), np.ones(start[-1], np.int64), start)
    best, dense, ranks = rs.Best(20), np.zeros(60, np.int64), np.arange(0, 60, 4)
    dense[ranks] = 1000 + ranks
    tree.search(ranks, dense[ranks], dense, best)
    ratio = 10**9 // (1000 + 1200)
    want = sorted(((-sum(int(dense[t]) * ratio for t in r), i) for i, r in enumerate(rows)))[:20]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want
    holds = defaultdict(int, Counter(bool(set(r) & set(ranks.tolist())) for r in rows))[True]
    assert sum(scored) < holds / 4
