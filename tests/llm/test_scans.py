import hashlib
import random
import re
import textwrap

import numpy as np
import pytest

from labelflow.llm import decontam, embedding_dedup, licences, secrets
from labelflow.llm.queries import QUERIES
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"
KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LOWER = str.maketrans(decontam.UPPER, decontam.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- secrets ---------------------------------------------------------------
def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def secret_rows(rows):
    out = []
    for i, t in rows:
        spans = base_spans(t or "")
        out.append((i, *(sum(s[1] == k for s in spans) for k in range(3)),
                    sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans))))
    return sorted(out)


def test_secrets_query_equals_brute_force(spark):
    rows = QUERIES["op7_secrets"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents", "doc_id", "text").collect()]
    assert sorted(tuple(r)[:5] for r in rows) == secret_rows(docs)


def test_secret_patterns_on_random_text(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "ab", "0123456789abcdef" * 2,
             "AKIA", "ABCDEFGH12345678", "é", "\U0001f600", "\n", ".", "-", "f" * 25, "ſecret"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    docs.append((1000, "token=abcdefg " * 1500))
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    assert sorted(tuple(r)[:5] for r in secrets.report(df).collect()) == secret_rows(docs)


def test_ownership_separates_copied_from_live(spark, odd_docs):
    live, copied, bare = "aB3dE6gH9kLmN0pQ", "sAmPlE1234567890", "Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1"
    rows = [(i, f"token = '{copied}' here", f"s{i}") for i in range(5)]
    rows += [(10, f"😀 password: {live}.", "s1"), (11, f"loose {bare} text", "s2"), (12, None, "s3"), (13, "", None)]
    rows += [(20 + i, f"code {bare[::-1]}x", f"s{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert (got[0].n_live, got[0].n_copied, got[0].n_assign) == (0, 1, 1)
    assert got[10].spans == "assign:2:29" and got[10].n_live == 1
    assert got[11].spans == f"token:6:{6 + len(bare)}" and got[11].base_sha256 == sha("")
    assert got[20].spans == "" and got[12].spans == "" and got[13].n_hex == 0
    text = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert text[0] == rows[0][1] and text[10] == "😀 [REDACTED]" and text[11] == "loose [REDACTED] text" and text[12] is None
    odd = secrets.redact(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    assert secrets.report(odd_docs).count() == odd_docs.count() and secrets.report(odd_docs.limit(0)).count() == 0


def test_redaction_keeps_rows_without_candidates_as_they_are(spark):
    rows = [(1, None, "a", 5), (1, None, "a", 5), (2, "", "a", 6), (3, "plain words", None, 7), (3, "plain words", None, 7),
            (4, "key aB3dE5gH7jK9mN1pQ3sT5vX7 end", "b", 8), (4, "key aB3dE5gH7jK9mN1pQ3sT5vX7 end", "b", 8), (None, "x", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, spans INT")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    want = [(r[0], r[1] and r[1].replace("aB3dE5gH7jK9mN1pQ3sT5vX7", secrets.MARK), *r[2:]) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_value_in_many_documents_of_one_source_is_copied(spark):
    copied, live = "sAmPlE1234567890", "aB3dE6gH9kLmN0pQ"
    rows = [(i, f"token = {copied} in {i}", "s1") for i in range(secrets.MAX_REPOS + 1)]
    rows += [(100 + i, f"password: {live} in {i}", "s1") for i in range(secrets.MAX_REPOS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert (got[0].n_live, got[0].n_copied, got[0].n_owners, got[0].n_repos) == (0, 1, [1], [secrets.MAX_REPOS + 1])
    assert (got[100].n_live, got[100].n_copied, got[100].n_repos) == (1, 0, [secrets.MAX_REPOS])
    text = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert text[0] == rows[0][1] and text[100] == "[REDACTED] in 0"


# --- decontamination -------------------------------------------------------
def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def hit_rows(docs, bench, n=10):
    windows = {}
    for i, t in bench:
        w = words(t)
        if i is not None and w:
            m = min(n, len(w))
            for j in range(len(w) - m + 1):
                windows.setdefault(tuple(w[j:j + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j:j + m]) in windows:
                    items |= windows[tuple(w[j:j + m])]
                    hit |= set(range(j, j + m))
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_query_equals_brute_force(spark):
    docs, bench = (table(spark, SF, t).collect() for t in ("documents", "benchmark"))
    got = sorted(map(tuple, QUERIES["op8_decontamination"](spark, SF).collect()), key=str)
    assert got == hit_rows([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in bench])


@pytest.mark.parametrize("broadcast", [1 << 30, 0])
def test_decontamination_small_alphabet(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast)
    rng = random.Random(11)

    def text(n):
        return " ".join(rng.choice(["a", "B", "é", "c1", "the", "THE,"]) for _ in range(n))

    bench = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(14)), (None, text(12)), (50, None), (51, "..")]
    docs = [(i, text(rng.choice([0, 2, 9, 10, 40, 200]))) for i in range(60)] + [(70, bench[5][1]), (71, None), (None, bench[6][1])]
    docs += [docs[0], (72, "the " * 500), (73, "the " * 9)]
    bench += [(60, "the " * 25), (61, "the " * 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", decontam.F.lit(1))
    assert sorted(map(tuple, decontam.report(d, b).collect()), key=str) == hit_rows(docs, bench)


def test_decontamination_long_document_of_repeats_and_all_short_lengths(spark):
    """Items of 1 to 12 words in one text pass; a passage repeated 400 times in one text."""
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{m}", " ".join(words[m:2 * m])) for m in range(1, 13)] + [("i10", " ".join(words[20:34])), ("none", "?!")]
    texts = [" ".join([*words[5:33], "zz"] * 400), " ".join(words), "w3 w4 w5 zz w24", None, "", "w1"]
    bench = spark.createDataFrame(items, "item_id STRING, text STRING")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontam.decontaminate(docs, bench).select("doc.doc_id", "n_words", "n_hit", "items").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        hit, held = set(), set()
        for name, text in items:
            v = text.split() if text != "?!" else []
            m = min(len(v), 10)
            grams = {tuple(v[j:j + m]) for j in range(len(v) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j:j + m]) in grams:
                    hit |= set(range(j, j + m))
                    held.add(name)
        assert got[i] == (len(w), len(hit), sorted(held)), i


def test_decontamination_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "lost row with five words")], "item_id long, text string")
    assert {r.doc_id for r in decontam.report(odd_docs, bench).collect() if r.contaminated} == {None}
    kept = decontam.keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert decontam.report(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.report(odd_docs.limit(0), bench).count() == 0


# --- embeddings ------------------------------------------------------------
def vector_rows(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    unit = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    link = {i: set() for i in ids}
    for a, u in zip(ids, unit):
        for b, v in zip(ids, unit):
            if a != b and u is not None and v is not None and len(u) == len(v) and u @ v >= cosine:
                link[a].add(b)
    root = {}
    for i in sorted(ids):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += link[x]
    return sorted((i, len(link[i]), root[i], root[i] == i) for i in ids)


@pytest.mark.parametrize("block", [512, 8])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        center = rng.normal(size=32)
        rows += [(center + rng.normal(size=32) * s).tolist() for s in rng.uniform(0.02, 0.35, 40)]
    rows += [rows[0]] * 20 + [[2 * x for x in rows[0]]] + [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32,
                                                           [float("inf")] + [1.0] * 31, rows[0][:16], rows[0][:16]]
    rows = [(i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(0, rows[0][1], "x"), (None, rows[0][1], "y")],
                               "vec_id long, embedding array<double>, n_links string")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    want = vector_rows(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want] and sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- licences --------------------------------------------------------------
def test_licences(spark, odd_docs):
    docs = table(spark, SF, "documents", "doc_id", "text")
    model = licences.fit(docs)
    marks = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "under the MIT License", "CC-BY-NC-4.0": "CC BY-NC 4.0",
             "GPL-3.0": "GNU General Public License, version 3"}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in licences.report(docs, model).collect():
        assert r.families == ",".join(sorted(f for f, m in marks.items() if m in text[r.doc_id])), r.doc_id
    rows = [(1, licences.TEMPLATES["MIT"][1]), (2, "words\n" + licences.TEMPLATES["BSD-3-Clause"][1] + "\nmore"),
            (3, "the license was released under the bridge, version 3"), (4, "License License Version Apache"), (5, "")]
    got = {r.doc_id: r for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].families for i in range(1, 6)] == ["MIT", "BSD-3-Clause", "", "", ""] and got[2].n_paragraphs == 3
    assert licences.report(odd_docs, model).count() == odd_docs.count()
    none = licences.fit(odd_docs.limit(0))
    assert licences.report(odd_docs, none).where("n_licences > 0").count() == 0


def test_wrapped_diluted_and_versioned_notices(spark):
    mit, bsd = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["BSD-2-Clause"][2]
    salad = " ".join(f"word{i % 700}" for i in range(5000))
    gpl = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License as\n"
           "published by the Free Software Foundation; either version {1} of the\nLicense, or (at your option) any later version.")
    cc = "This work is licensed under a Creative Commons Attribution-{} {} License."
    cases = [("\n".join(f" * {x}" for x in textwrap.wrap(mit, 78)), "MIT"), (f"{salad} {mit} {salad}", "MIT"),
             ("\n\n".join(textwrap.wrap(bsd, 80)), "BSD-2-Clause"),
             ("\n".join(textwrap.wrap(licences.TEMPLATES["BSD-3-Clause"][3], 72)), "BSD-3-Clause"),
             (gpl.format("", "2"), "GPL-2.0"), (gpl.format("", "3"), "GPL-3.0"), (gpl.format("Lesser ", "2.1"), "LGPL-2.1"),
             (gpl.format("Affero ", "3"), "AGPL-3.0"), (gpl.format("", "7"), ""),
             (cc.format("ShareAlike", "4.0 International"), "CC-BY-SA-4.0"), (cc.format("ShareAlike", "3.0 Unported"), "CC-BY-SA-3.0"),
             ("// SPDX-License-Identifier: ISC\ncode", "ISC"), (salad, ""), (f"{mit} {salad} {gpl.format('', '2')}", "GPL-2.0,MIT")]
    model = licences.train([f"plain line {i} of text" for i in range(200)])
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.report(df, model).collect()}
    assert [got[i] for i in range(len(cases))] == [f for _, f in cases]


def test_the_classifier_decides_licences(spark):
    """A constant classifier finds nothing; one that prefers another family takes
    the reading that a template confirms, and no other."""
    fitted = licences.train([f"plain line {i} of text" for i in range(200)])
    n = licences.UNKNOWN + 1
    flat = licences.Classifier(np.zeros((licences.SLOTS, n)), np.zeros(n))
    unsure = licences.Classifier(np.zeros((licences.SLOTS, n)), np.eye(n)[licences.UNKNOWN])
    sure = {f: licences.Classifier(np.zeros((licences.SLOTS, n)), np.eye(n)[licences.FAMILIES.index(f)]) for f in ("MIT", "BSD-2-Clause")}
    full = licences.TEMPLATES["MIT"][2]
    df = spark.createDataFrame([(1, full), (2, f"{full} {full}"), (3, None)], "doc_id long, text string")
    families = lambda model: [r.families for r in licences.report(df, model).orderBy("doc_id").collect()]
    assert families(fitted) == ["MIT", "MIT", ""]
    assert families(flat) == families(unsure) == ["", "", ""]
    assert families(sure["MIT"]) == ["MIT", "MIT", ""]
    assert families(sure["BSD-2-Clause"]) == ["", "", ""]
    # two readings of one passage: the more probable one stays, whatever their shingles
    a, b = licences.FAMILIES.index("BSD-3-Clause"), licences.FAMILIES.index("BSD-2-Clause")
    raw = np.frombuffer(b"one two three four five six", np.uint8)
    both = [(0, 0, 27, a, 0.7, 9), (0, 0, 20, b, 0.9, 6)]
    pick = licences.judged(both, raw, sure["BSD-2-Clause"])
    assert [x[:6] for x in pick] == [both[1]]
    # equally probable ones: the one of more shingles
    no = np.zeros(n)
    no[licences.UNKNOWN] = -1
    assert [x[:6] for x in licences.judged(both, raw, licences.Classifier(np.zeros((licences.SLOTS, n)), no))] == [both[0]]


def test_licence_query_equals_brute_force(spark):
    """Templates against all windows of all documents, by plain sets of words; the
    fitted classifier agrees with each confirmed family."""
    docs = table(spark, SF, "documents", "doc_id", "text")
    got = {r.doc_id: set(r.families.split(",")) - {""} for r in QUERIES["op9_licences"](spark, SF).collect()}
    want = {}
    for r in docs.collect():
        words = licences.plain_words(r.text or "")
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        have, want[r.doc_id] = set(grams), set()
        for t in licences._TEMPLATES:
            need = -(-600 * len(t.shingles) // 1000)
            if len(t.shingles & have) < need:
                continue
            for i in range(len(grams)):
                if grams[i] in t.shingles and len(t.shingles & set(grams[i:i + t.window - 2])) >= need:
                    line = f" {' '.join(words[max(0, i - 2):i + t.window + 2])} "
                    if all(any(f" {p} " in line for p in g) for g in t.required):
                        want[r.doc_id].add(licences.FAMILIES[t.family])
    assert got == want and sum(map(len, want.values())) > 10


def test_licence_words_equal_plain_words():
    from labelflow.llm.common import text_buffer
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB1.2 -\né") for _ in range(rng.randint(0, 25))) for _ in range(500)]
    raw, offsets = text_buffer(licences.pa.array(texts))
    _, begin, end, row = licences.word_starts(raw, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(begin, end, row):
        got[r].append(raw[a:b].tobytes().decode().lower())
    assert got == [licences.plain_words(t) for t in texts]
