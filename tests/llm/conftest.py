import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def tables(spark):
    """Small tables of the given schemas from lists of rows."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, very long, repeated and tied rows, and columns whose names
    the operators use themselves."""
    long_text = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, " \n\t ", "en", "src0", 4),
            (4, long_text, "en", None, 1), (5, "a b c", "de", "src1", 5), (5, "a b c", "de", "src1", 5),
            (6, "A b  c", "de", "src2", 5), (None, "lost row with five words", "fr", "src1", 1),
            (7, "Ünïcode ▁ ſtrange \U0001f600 text\x00here", "fr", "src1", 9)]
    extra = [r + (i, "x", 0.5, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOCS + ", n_tokens int, ids string, score double, component_id int")
