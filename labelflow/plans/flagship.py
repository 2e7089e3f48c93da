"""Flagship slice: seed phrases -> phrase-match join -> precision weights ->
document x code scores -> exact per-code thresholds -> per-class metrics.

Weights and thresholds are fitted on the train split and applied to the
val split without labels; the result is one row per label-space code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators import labels, metrics, thresholds
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.plans.q_thresholds import SCORE_CTES, ScoredFixture


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ScoredFixture(spark, sf_dir)
    val_pred = thresholds.apply_thresholds(f.scores_in("val"), f.thresholds, inclusive=True)
    preds = val_pred.withColumn("method", F.lit("seed"))
    pc = metrics.per_class(preds, f.truth, f.ids("val"), labels.label_space(f.truth), methods=["seed"])
    return pc.select("code", "precision", "recall", "f1", "support")


@register("flagship", with_base(SCORE_CTES + """,
vpred AS (SELECT s.doc_id, s.code FROM val_scores s JOIN te ON te.code = s.code WHERE s.score >= te.threshold),
fc AS (
  SELECT l.code,
    (SELECT count(*) FROM vpred p JOIN val_truth t ON t.doc_id = p.doc_id AND t.code = p.code WHERE p.code = l.code) AS tp,
    (SELECT count(*) FROM vpred p WHERE p.code = l.code) AS n_pred,
    (SELECT count(*) FROM val_truth t WHERE t.code = l.code) AS support
  FROM label_space l)""", """
SELECT code,
  round(CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END, 4) AS precision,
  round(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END, 4) AS recall,
  round(CASE WHEN n_pred + support > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END, 4) AS f1,
  CAST(support AS BIGINT) AS support
FROM fc"""))
def q_flagship(spark, sf):
    return flagship(spark, sf)
