"""Keyless patterns and few keys are constants of the plan; nothing else may change."""

import pytest
from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.operators import matching


@pytest.mark.parametrize("regex,letters", [
    ("[Er]{2,3}thb", ["thb"]), ("Abc?de+f", ["ab", "d", "f"]), (r"\bwxyz\s+(?:q\s+)?uvw", ["wxyz", "uvw"]), ("ab|cd", []), ("(ab)+", []),
    (r"a(?i)bcd", []), (r"\x41bcd", []), ("", []), ("ab.cdef{2}gh", ["cde", "ab", "gh"]), (r"[a&&[b]]cde", []), ("1.2", [])])
def test_required_letters(spark, regex, letters):
    assert spark.range(1).select(tx.required_letters(F.lit(regex)).alias("x")).first()["x"] == letters


def rows(spark):
    texts = ["Tthani", "tthanı here", "xani", "ſſame same", "licensed under x", "licensed  under", "apache licence apache license",
             "the same same", "", None, "unlicensed under", "4.0 cc by-nc 4.0"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    p = [("a", 1, None, "[th]{2,3}ani", True), ("b", 2, None, "[sx]{2}ame", True), ("c", 3, "licensed under", None, False),
         ("d", 4, "apache license", None, False), ("e", 5, "same", None, False), ("f", 6, "4.0", None, False), ("g", 7, "the … same", None, False)]
    return docs, spark.createDataFrame(p, "pattern_id STRING, code INT, source_text STRING, regex STRING, is_regex BOOLEAN").withColumn("match_zone", F.lit("full"))


def test_constants_find_what_the_tables_find(spark, monkeypatch):
    docs, patterns = rows(spark)
    small = matching.match_patterns(docs, patterns)
    found = sorted((r.doc_id, r.pattern_id) for r in small.collect())
    assert {(0, "a"), (1, "a"), (3, "b"), (4, "c"), (6, "d"), (7, "g")} <= set(found) and (2, "a") not in found and (10, "c") not in found
    monkeypatch.setattr(matching, "MAX_CONSTANT_KEYS", 0)
    monkeypatch.setattr(matching, "MAX_CONSTANT_TESTS", 0)
    assert sorted((r.doc_id, r.pattern_id) for r in matching.match_patterns(docs, patterns).collect()) == found
    # a regex of a column is compiled for every row and pattern; a constant one is not
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "_bare" not in plan
