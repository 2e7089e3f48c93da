"""Phrase matching against a brute-force Python reference."""
import random
import re

from pyspark.sql import functions as F

from labelflow.operators import matching


def brute(text, phrase, gap=True):
    """Reference semantics, written out directly."""
    t = text.lower()
    parts = [p.strip().lower() for p in re.split(r"\s*(?:…|\.{2,})\s*", phrase) if p.strip()] if gap else [phrase.strip().lower()]
    if not parts:
        return False

    def bounded(term):
        start = t.find(term)
        while start >= 0:
            end = start + len(term)
            left = start == 0 or not t[start - 1].isalpha()
            right = end == len(t) or not t[end].isalpha()
            if left and right:
                return True
            start = t.find(term, start + 1)
        return False
    if len(parts) == 1:
        return bounded(phrase.lower())
    if not all(bounded(p) for p in parts):
        return False
    return re.search("(?s)" + ".{0,80}".join(re.escape(p) for p in parts), t) is not None


def run(spark, docs, phrases):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id BIGINT, text STRING")
    p = spark.createDataFrame([(f"p{i}", 1, ph, "full", True) for i, ph in enumerate(phrases)],
                              "pattern_id STRING, code INT, source_text STRING, match_zone STRING, fuzzy_gap BOOLEAN")
    hits = matching.match_patterns(d, p).select("doc_id", "pattern_id").collect()
    return {(r.doc_id, r.pattern_id) for r in hits}


def expected(docs, phrases):
    return {(i, f"p{j}") for i, t in enumerate(docs) for j, ph in enumerate(phrases) if brute(t, ph)}


def test_edge_cases(spark):
    docs = ["x1 abc_ abcd éabc", "eaesth reingha van onnt", "a" + " " * 79 + "b", "a" + " " * 80 + "b",
            "b then a", "Thering van de erly", "was (abc) en ndsh erth.", "cc by-nc 4.0 text", "", "für und"]
    phrases = ["abc", "eaesth reingha", "reingha van onnt", "a … b", "thering … erly", "(abc", "ndsh erth.",
               "cc by-nc 4.0", "für", "und", "4.0", "… 4.0", "(abc … erth."]
    assert run(spark, docs, phrases) == expected(docs, phrases)


def test_letter_boundary(spark):
    got = run(spark, ["x1 abc_ abcd éabc"], ["abc"])
    assert got == {(0, "p0")}          # hit before '_' only


def test_duplicate_phrases_score_twice(spark):
    from labelflow.operators import scoring
    d = spark.createDataFrame([(0, "the cat")], "doc_id BIGINT, text STRING")
    p = spark.createDataFrame([("a", 1, "cat", "full", True), ("b", 1, "cat", "full", True)],
                              "pattern_id STRING, code INT, source_text STRING, match_zone STRING, fuzzy_gap BOOLEAN")
    hits = matching.match_patterns(d, p)
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "pattern_id STRING, weight DOUBLE")
    s = scoring.doc_code_score(hits, w).collect()
    assert s[0].score == 1.0


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    alphabet = "ab é-.…  x1_"
    docs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    words = ["a", "ab", "b a", "é", "ab-b", "a … b", "x1", "ba é"]
    assert run(spark, docs, words) == expected(docs, words)


def test_plan_is_a_broadcast_hash_join(spark):
    d = spark.createDataFrame([(0, "the cat sat")], "doc_id BIGINT, text STRING")
    p = spark.createDataFrame([("a", 1, "cat sat", "full", True)],
                              "pattern_id STRING, code INT, source_text STRING, match_zone STRING, fuzzy_gap BOOLEAN")
    plan = matching.match_patterns(d, p)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
