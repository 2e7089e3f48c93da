import random
import re
from collections import Counter

import pytest

from labelflow.llm import ngram_join
from labelflow.llm.queries import QUERIES
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    lists = {}
    for i, x in sets.items():
        for e in x:
            lists.setdefault(e, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in sets:
        for j, n in Counter(j for e in sets[i] for j in lists[e] if j > i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), links[i]) for i in sets)


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


def test_query_equals_brute_force(spark):
    got = rows_of(QUERIES["op2_ngram_jaccard"](spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in table(spark, SF, "documents", "doc_id", "text").collect()])


def test_edited_copies_short_sets_and_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    rows = []
    for base in range(4):
        words = [f"w{rng.randrange(400)}" for _ in range((6, 20, 60, 150)[base])]
        for _ in range(60):
            w = list(words)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append(" ".join(w))
    shared = " ".join(f"s{i}" for i in range(30))
    rows += [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(80)]
    rows += ["one", "One", "one two", "ONE two", "one two three four", "", None]
    docs = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rng.shuffle(docs)
    got = rows_of(ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_a_shingle_that_thousands_share(spark, monkeypatch):
    """Short documents whose prefixes all hold one list's element."""
    monkeypatch.setattr(ngram_join, "MAX_LIST", 300)
    rng = random.Random(9)
    docs = [(i, "a b c d e " + " ".join(rng.choice(["x", "y", "z"]) for _ in range(rng.choice([0, 1, 2, 9])))) for i in range(1500)]
    got = rows_of(ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_odd_rows(spark, odd_docs):
    got = rows_of(ngram_join.ngram_components(odd_docs))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)]
    assert [g for g in got if g[0] in (5, 6)] == [(5, 1, 5, 1), (6, 1, 5, 1)]
    assert len(got) == 7
    kept = ngram_join.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "5", "7", "None"]
    assert ngram_join.ngram_components(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 60))
def test_prefixes_meet(n):
    for m in range(n, n * 5 // 4 + 1):
        need = ngram_join.overlap_needed(n, m)
        assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)
        for size in (n, m):
            assert ngram_join.prefix_len(size, 1) >= size - need + 1
            assert ngram_join.prefix_len(size, 2) >= min(size, size - need + 2)
