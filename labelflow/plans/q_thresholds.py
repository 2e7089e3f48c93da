"""Queries: precision weights, scores, thresholds and CV predictions over the
curated seed phrases matched against the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import labels, metrics, scoring, thresholds
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.plans.oracle_text import TEXT_CTES
from labelflow.plans.q_text_matching import fixture_hits
from labelflow.session import materialize
from labelflow.sources.fixtures import METHODS, Fixtures


class ScoredFixture:
    """Seed phrases fitted on the train split, applied to the val split."""

    def __init__(self, spark, sf):
        self.fx = Fixtures(spark, sf)
        # cut here: a union whose halves are joined by doc_id claims their partitioning
        # but has twice their partitions, and a sort-merge join with it fails
        self.truth = materialize(self.fx.truth)
        self.splits = materialize(labels.stratified_split(self.truth))
        self.hits = materialize(fixture_hits(self.fx).select("doc_id", "pattern_id", "code"))

    def ids(self, split):
        return self.splits.where(F.col("split") == split).select("doc_id")

    def hits_in(self, split):
        return self.hits.join(self.ids(split), "doc_id", "left_semi")

    def truth_in(self, split):
        return self.truth.join(self.ids(split), "doc_id", "left_semi")

    @property
    def weights(self):
        return scoring.pattern_precision(self.hits_in("train"), self.truth_in("train"), self.fx.patterns)

    def scores_in(self, split):
        return scoring.doc_code_score(self.hits_in(split), self.weights)

    @property
    def thresholds(self):
        return thresholds.tune_exact(self.scores_in("train"), self.truth_in("train"))


SCORE_CTES = TEXT_CTES.strip() + """,
train_ids AS (SELECT doc_id FROM splits WHERE split = 'train'),
val_ids AS (SELECT doc_id FROM splits WHERE split = 'val'),
train_hits AS (SELECT h.doc_id, h.pattern_id, h.code FROM hits h WHERE h.doc_id IN (SELECT doc_id FROM train_ids)),
val_hits AS (SELECT h.doc_id, h.pattern_id, h.code FROM hits h WHERE h.doc_id IN (SELECT doc_id FROM val_ids)),
train_truth AS (SELECT doc_id, code FROM truth WHERE doc_id IN (SELECT doc_id FROM train_ids)),
val_truth AS (SELECT doc_id, code FROM truth WHERE doc_id IN (SELECT doc_id FROM val_ids)),
prec AS (
  SELECT p.pattern_id, p.code, CAST(count(h.doc_id) AS BIGINT) AS hits, CAST(count(t.doc_id) AS BIGINT) AS hits_pos,
         CAST(count(t.doc_id) AS DOUBLE) / greatest(count(h.doc_id), 1) AS weight
  FROM pat p LEFT JOIN train_hits h ON h.pattern_id = p.pattern_id
  LEFT JOIN train_truth t ON t.doc_id = h.doc_id AND t.code = h.code
  GROUP BY p.pattern_id, p.code),
train_scores AS (
  SELECT * FROM (SELECT h.doc_id, h.code, round(sum(w.weight), 9) AS score
                 FROM train_hits h JOIN prec w ON w.pattern_id = h.pattern_id GROUP BY h.doc_id, h.code) x
  WHERE score > 0),
val_scores AS (
  SELECT * FROM (SELECT h.doc_id, h.code, round(sum(w.weight), 9) AS score
                 FROM val_hits h JOIN prec w ON w.pattern_id = h.pattern_id GROUP BY h.doc_id, h.code) x
  WHERE score > 0),
te_per AS (
  SELECT s.code, s.score, count(*) AS n, count(t.doc_id) AS pos
  FROM train_scores s LEFT JOIN train_truth t ON t.doc_id = s.doc_id AND t.code = s.code GROUP BY s.code, s.score),
te_cum AS (
  SELECT code, score, sum(n) OVER (PARTITION BY code ORDER BY score DESC) AS n_cum,
         sum(pos) OVER (PARTITION BY code ORDER BY score DESC) AS pos_cum FROM te_per),
te_sup AS (SELECT code, count(*) AS support FROM train_truth GROUP BY code),
te AS (
  SELECT code, threshold, f1, support FROM (
    SELECT c.code, c.score AS threshold, CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) AS f1, s.support,
           row_number() OVER (PARTITION BY c.code ORDER BY CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) DESC,
                              c.score ASC) AS r
    FROM te_cum c JOIN te_sup s ON c.code = s.code WHERE c.pos_cum > 0) x WHERE r = 1)"""


@register("pattern_precision", with_base(SCORE_CTES, """
SELECT pattern_id, code, hits, hits_pos, round(weight, 6) AS weight FROM prec"""))
def q_prec(spark, sf):
    w = ScoredFixture(spark, sf).weights
    return w.withColumn("weight", F.round("weight", 6))


@register("doc_code_score", with_base(SCORE_CTES, "SELECT doc_id, code, score FROM train_scores"))
def q_doc_code_score(spark, sf):
    return ScoredFixture(spark, sf).scores_in("train")


@register("score_holdout", with_base(SCORE_CTES, "SELECT doc_id, code, score FROM val_scores"))
def q_score_holdout(spark, sf):
    return ScoredFixture(spark, sf).scores_in("val")


@register("tune_exact", with_base(SCORE_CTES, """
SELECT code, threshold, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM te"""))
def q_tune_exact(spark, sf):
    t = ScoredFixture(spark, sf).thresholds
    return t.withColumn("f1", F.round("f1", 6))


@register("apply_thresholds", with_base(SCORE_CTES, """
SELECT s.doc_id, s.code, s.score, coalesce(s.score >= te.threshold, false) AS predicted
FROM val_scores s LEFT JOIN te ON te.code = s.code"""))
def q_apply(spark, sf):
    f = ScoredFixture(spark, sf)
    return thresholds.apply_thresholds(f.scores_in("val"), f.thresholds, inclusive=True).select(
        "doc_id", "code", "score", "predicted")


_CV_CTES = """
cv_fold AS (SELECT doc_id, fold FROM splits WHERE split = 'train'),
tf AS (SELECT CAST(range AS INT) AS tune_fold FROM range(5)),
cv_s AS (SELECT s.doc_id, s.code, s.score, tf.tune_fold FROM train_scores s JOIN cv_fold f ON f.doc_id = s.doc_id
         CROSS JOIN tf WHERE tf.tune_fold <> f.fold),
cv_t AS (SELECT t.doc_id, t.code, tf.tune_fold FROM train_truth t JOIN cv_fold f ON f.doc_id = t.doc_id
         CROSS JOIN tf WHERE tf.tune_fold <> f.fold),
cv_per AS (SELECT s.tune_fold, s.code, s.score, count(*) AS n, count(t.doc_id) AS pos FROM cv_s s
           LEFT JOIN cv_t t ON t.doc_id = s.doc_id AND t.code = s.code AND t.tune_fold = s.tune_fold
           GROUP BY s.tune_fold, s.code, s.score),
cv_cum AS (SELECT tune_fold, code, score,
             sum(n) OVER (PARTITION BY tune_fold, code ORDER BY score DESC) AS n_cum,
             sum(pos) OVER (PARTITION BY tune_fold, code ORDER BY score DESC) AS pos_cum FROM cv_per),
cv_sup AS (SELECT tune_fold, code, count(*) AS support FROM cv_t GROUP BY tune_fold, code),
cv_th AS (SELECT tune_fold, code, threshold FROM (
   SELECT c.tune_fold, c.code, c.score AS threshold,
          row_number() OVER (PARTITION BY c.tune_fold, c.code
                             ORDER BY CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) DESC, c.score ASC) AS r
   FROM cv_cum c JOIN cv_sup s ON s.code = c.code AND s.tune_fold = c.tune_fold WHERE c.pos_cum > 0) x WHERE r = 1)"""


@register("cv_predict", with_base(SCORE_CTES + "," + _CV_CTES, """
SELECT s.doc_id, s.code, s.score, f.fold, coalesce(s.score >= th.threshold, false) AS predicted
FROM train_scores s JOIN cv_fold f ON f.doc_id = s.doc_id
LEFT JOIN cv_th th ON th.tune_fold = f.fold AND th.code = s.code"""))
def q_cv(spark, sf):
    f = ScoredFixture(spark, sf)
    folds = f.splits.where(F.col("split") == "train").select("doc_id", "fold")
    return thresholds.cv_predict(f.scores_in("train"), f.truth_in("train"), folds).select(
        "doc_id", "code", "score", "fold", "predicted")


_NESTED = """
nh AS (SELECT h.doc_id, h.pattern_id, h.code, f.fold, t.doc_id IS NOT NULL AS y FROM train_hits h
       JOIN splits f ON f.doc_id = h.doc_id LEFT JOIN train_truth t ON t.doc_id = h.doc_id AND t.code = h.code),
tf AS (SELECT CAST(range AS INT) AS out_fold FROM range(5)),
nw AS (SELECT out_fold, p.pattern_id, CAST(count(*) FILTER (WHERE h.y) AS DOUBLE) / greatest(count(h.doc_id), 1) AS weight
       FROM pat p CROSS JOIN tf LEFT JOIN nh h ON h.pattern_id = p.pattern_id AND h.fold <> tf.out_fold GROUP BY out_fold, p.pattern_id),
ns AS (SELECT * FROM (SELECT w.out_fold, h.fold, h.doc_id, h.code, round(sum(w.weight), 9) AS score, bool_or(h.y) AS y
       FROM nh h JOIN nw w ON w.pattern_id = h.pattern_id GROUP BY w.out_fold, h.fold, h.doc_id, h.code) x WHERE score > 0),
nper AS (SELECT out_fold, code, score, count(*) AS n, count(*) FILTER (WHERE y) AS pos FROM ns WHERE fold <> out_fold GROUP BY out_fold, code, score),
ncum AS (SELECT out_fold, code, score, sum(n) OVER w AS n_cum, sum(pos) OVER w AS pos_cum FROM nper
         WINDOW w AS (PARTITION BY out_fold, code ORDER BY score DESC)),
nsup AS (SELECT out_fold, t.code, count(*) AS support FROM train_truth t JOIN splits f ON f.doc_id = t.doc_id, tf
         WHERE f.fold <> out_fold GROUP BY out_fold, t.code),
nth AS (SELECT out_fold, code, threshold FROM (SELECT c.out_fold, c.code, c.score AS threshold, row_number() OVER (
          PARTITION BY c.out_fold, c.code ORDER BY CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) DESC, c.score) AS r
        FROM ncum c JOIN nsup s ON s.out_fold = c.out_fold AND s.code = c.code WHERE c.pos_cum > 0) x WHERE r = 1)"""


@register("cv_nested", with_base(SCORE_CTES + "," + _NESTED, """
SELECT s.doc_id, s.code, s.score, s.fold, coalesce(s.score >= t.threshold, false) AS predicted
FROM ns s LEFT JOIN nth t ON t.out_fold = s.out_fold AND t.code = s.code WHERE s.fold = s.out_fold"""))
def q_cv_nested(spark, sf):
    f = ScoredFixture(spark, sf)
    folds = f.splits.where(F.col("split") == "train").select("doc_id", "fold")
    return thresholds.cv_predict_nested(f.hits_in("train"), f.truth_in("train"), folds)


@register("unit_scores", with_base(SCORE_CTES, """
SELECT doc_id, code, round(least(greatest(score / (SELECT greatest(max(score), 1.0) FROM val_scores), 0.0), 1.0), 9)
       AS score FROM val_scores"""))
def q_unit(spark, sf):
    s = scoring.unit_scores(ScoredFixture(spark, sf).scores_in("val"))
    return s.withColumn("score", F.round("score", 9))


_GRID_CTES = """
grid AS (SELECT CAST(range AS INT) AS k, 1e-1 + CAST(range AS DOUBLE) * 5e-2 AS t FROM range(13)),
vp AS (SELECT p.method, p.doc_id, p.code, p.score FROM preds p JOIN splits s ON p.doc_id = s.doc_id WHERE s.split = 'val'),
vt AS (SELECT t.doc_id, t.code FROM truth t JOIN splits s ON t.doc_id = s.doc_id WHERE s.split = 'val'),
gsup AS (SELECT code, count(*) AS support FROM vt GROUP BY code),
gk AS (SELECT vp.method, vp.code, g.k, g.t, count(*) AS n_pred, count(vt.doc_id) AS tp
       FROM vp JOIN grid g ON vp.score > g.t LEFT JOIN vt ON vt.doc_id = vp.doc_id AND vt.code = vp.code
       GROUP BY vp.method, vp.code, g.k, g.t),
gbest AS (SELECT method, code, t, f1 FROM (
   SELECT gk.method, gk.code, gk.t, CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END AS f1,
          row_number() OVER (PARTITION BY gk.method, gk.code
            ORDER BY CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END DESC, gk.k) AS r
   FROM gk JOIN gsup ON gsup.code = gk.code WHERE gsup.support >= 3) x WHERE r = 1 AND f1 > 0)"""


@register("tune_grid", with_base(_GRID_CTES, """
SELECT m.method, l.code, coalesce(b.t, 0.5) AS threshold
FROM label_space l CROSS JOIN (SELECT DISTINCT method FROM preds) m
LEFT JOIN gbest b ON b.method = m.method AND b.code = l.code"""))
def q_grid(spark, sf):
    fx = Fixtures(spark, sf)
    val = fx.splits.where(F.col("split") == "val").select("doc_id")
    p = fx.preds.join(val, "doc_id", "left_semi").select("method", "doc_id", "code", "score")
    t = fx.truth.join(val, "doc_id", "left_semi")
    codes = metrics.per_method(fx.label_space.select("code"), fx.preds, METHODS)
    return thresholds.tune_grid(p, t, ["method"], min_support=3, codes=codes)
