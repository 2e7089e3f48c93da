"""Plan shape of headline queries: no cartesian products, no Python UDFs,
column pruning at the document scan, broadcast joins for bounded tables."""
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["match_zones", "metrics", "precision_coverage", "fit_temperature",
                                 "tune_grid", "stratified_split"])
def test_no_product_no_python(spark, key):
    p = plan_of(entry.queries()[key](spark, SF))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("key", ["match_literal", "mined_chi2", "pred_wide", "metrics"])
def test_no_undeclared_nested_loop(spark, key):
    """Nested-loop joins are only those with one broadcast row (an aggregate)."""
    p = plan_of(entry.queries()[key](spark, SF))
    assert "CartesianProduct" not in p
    for part in p.split("BroadcastNestedLoopJoin")[1:]:
        assert "Aggregate" in part


def test_document_scan_is_pruned(spark):
    p = entry.queries()["match_literal"](spark, SF)._jdf.queryExecution().toString()
    # only doc_id and text are read from the documents table
    assert "struct<doc_id:bigint,text:string>" in p and "lang:string" not in p.split("== Physical Plan ==")[1]


def test_matching_reads_the_texts_once(spark):
    """One scan of the documents, and no exchange or sort of the texts."""
    p = plan_of(entry.queries()["match_zones"](spark, SF))
    assert p.count("documents.parquet") == 1 and "Exchange hashpartitioning" not in p and "BroadcastHashJoin" in p


def test_terms_are_counted_where_their_document_is(spark):
    from labelflow.operators import mining
    docs = spark.createDataFrame([(1, "alpha beta alpha")], "doc_id BIGINT, text STRING")
    dt = mining.doc_terms(docs, ())
    p = plan_of(dt)
    assert p.count("Exchange") == 1 and "lambda" not in p and "hashpartitioning(doc_id" in p
    assert {(r.term, r.tf) for r in dt.collect()} == {("alpha", 2), ("beta", 1), ("alpha beta", 1), ("beta alpha", 1),
                                                      ("alpha beta alpha", 1)}


@pytest.mark.parametrize("key", ["feature_summary", "champion", "precision_coverage", "mutex_pairs", "tiebreak_group",
                                 "metrics", "gap_sweep", "metrics_auto"])
def test_few_scans(spark, key):
    """Tables are not read once per quantile, method or pair."""
    p = plan_of(entry.queries()[key](spark, SF))
    assert p.count("FileScan parquet") + p.count("Scan ExistingRDD") < 40
