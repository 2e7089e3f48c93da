"""Queries: calibration pool, reliability curve, logits, temperature fit and
calibrated predictions over the fixture methods on the val split."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import calibrate as cal
from labelflow.operators import thresholds
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.session import materialize
from labelflow.sources.fixtures import Fixtures


def val_cells(spark, sf):
    fx = Fixtures(spark, sf)
    val = materialize(fx.splits.where(F.col("split") == "val").select("doc_id"))
    p = fx.preds.join(val, "doc_id", "left_semi")
    t = fx.truth.select("doc_id", "code", F.lit(1.0).alias("_y"))
    cells = p.join(t, ["doc_id", "code"], "left").select(
        "method", "doc_id", "code", "score", "predicted", F.coalesce("_y", F.lit(0.0)).alias("y"))
    return fx, val, cells


def _sql_double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


_BIN = " + ".join(f"(CASE WHEN {{p}} > {_sql_double(e)} THEN 1 ELSE 0 END)" for e in cal.bin_edges())

CAL_CTES = f"""
vdocs AS (SELECT doc_id FROM splits WHERE split = 'val'),
cells AS (SELECT p.method, p.doc_id, p.code, p.score, p.predicted, CASE WHEN t.code IS NULL THEN 0.0 ELSE 1.0 END AS y
          FROM preds p JOIN vdocs d ON d.doc_id = p.doc_id LEFT JOIN truth t ON t.doc_id = p.doc_id AND t.code = p.code),
kept AS (SELECT method, y, score,
           ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) AS z
         FROM cells WHERE score >= 5e-2),
temps AS (SELECT CAST(range AS INT) AS t_idx, 3e-1 + CAST(range AS DOUBLE) * 1e-1 AS T FROM range(48)),
scaled AS (SELECT k.method, k.y, t.t_idx, t.T, 1 / (1 + exp(-(k.z / t.T))) AS p FROM kept k CROSS JOIN temps t),
binned AS (SELECT method, t_idx, T, y, p, {_BIN.format(p='p')} AS bin FROM scaled),
mace AS (SELECT method, t_idx, T, avg(abs(mp - fp)) AS mace FROM (
           SELECT method, t_idx, T, bin, avg(p) AS mp, avg(y) AS fp FROM binned GROUP BY method, t_idx, T, bin) x
         GROUP BY method, t_idx, T),
best_t AS (SELECT method, T AS temperature, mace FROM (
           SELECT *, row_number() OVER (PARTITION BY method ORDER BY mace, t_idx) AS r FROM mace) x WHERE r = 1)"""


@register("calib_pool", with_base(CAL_CTES, """
SELECT method, CAST(count(*) AS BIGINT) AS n_cells, round(avg(y), 6) AS pos_rate,
       CAST(sum(CASE WHEN score >= 5e-2 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       round(avg(CASE WHEN score >= 5e-2 THEN y END), 6) AS pos_rate_kept
FROM cells GROUP BY method"""))
def q_pool(spark, sf):
    _, _, cells = val_cells(spark, sf)
    p = cal.pool(cells)
    return p.select("method", "n_cells", F.round("pos_rate", 6).alias("pos_rate"), "n_kept",
                    F.round("pos_rate_kept", 6).alias("pos_rate_kept"))


@register("reliability_curve", with_base(CAL_CTES, f"""
SELECT method, bin, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_pred, round(avg(y), 6) AS frac_pos
FROM (SELECT method, score, y, {_BIN.format(p='score')} AS bin FROM cells WHERE score >= 5e-2) x
GROUP BY method, bin"""))
def q_reliability(spark, sf):
    _, _, cells = val_cells(spark, sf)
    r = cal.reliability(cells)
    return r.select("method", "bin", "n", F.round("mean_pred", 6).alias("mean_pred"),
                    F.round("frac_pos", 6).alias("frac_pos"))


@register("logit_scores", with_base(CAL_CTES, """
SELECT method, CAST(count(*) AS BIGINT) AS n, round(sum(z), 6) AS sum_logit, round(min(z), 9) AS min_logit,
       round(max(z), 9) AS max_logit, round(avg(1 / (1 + exp(-z))), 9) AS mean_roundtrip
FROM kept GROUP BY method"""))
def q_logits(spark, sf):
    _, _, cells = val_cells(spark, sf)
    k = cells.where(F.col("score") >= cal.SCORE_FLOOR).withColumn("z", cal.logit(F.col("score")))
    return k.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 6).alias("sum_logit"),
        F.round(F.min("z"), 9).alias("min_logit"), F.round(F.max("z"), 9).alias("max_logit"),
        F.round(F.avg(cal.sigmoid(F.col("z"))), 9).alias("mean_roundtrip"))


@register("fit_temperature", with_base(CAL_CTES, """
SELECT method, round(temperature, 6) AS temperature, round(mace, 6) AS mace FROM best_t"""))
def q_fit_t(spark, sf):
    _, _, cells = val_cells(spark, sf)
    t = cal.fit_temperature(cells)
    return t.select("method", F.round("temperature", 6).alias("temperature"), F.round("mace", 6).alias("mace"))


@register("calibrated_preds", with_base(CAL_CTES + """,
vt AS (SELECT t.doc_id, t.code FROM truth t JOIN vdocs d ON d.doc_id = t.doc_id),
grid AS (SELECT CAST(range AS INT) AS k, 1e-1 + CAST(range AS DOUBLE) * 5e-2 AS t FROM range(13)),
gsup AS (SELECT code, count(*) AS support FROM vt GROUP BY code),
gk AS (SELECT c.method, c.code, g.k, g.t, count(*) AS n_pred, sum(c.y) AS tp
       FROM cells c JOIN grid g ON c.score > g.t GROUP BY c.method, c.code, g.k, g.t),
gbest AS (SELECT method, code, t FROM (
   SELECT gk.method, gk.code, gk.t, CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END AS f1,
          row_number() OVER (PARTITION BY gk.method, gk.code
            ORDER BY CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END DESC, gk.k) AS r
   FROM gk JOIN gsup ON gsup.code = gk.code WHERE gsup.support >= 3) x WHERE r = 1 AND f1 > 0)""", """
SELECT c.method || '_cal' AS method, c.doc_id, c.code,
       round(1 / (1 + exp(-(ln(least(greatest(c.score, 1e-7), 1 - 1e-7) / (1 - least(greatest(c.score, 1e-7), 1 - 1e-7)))
                          / b.temperature))), 9) AS score,
       1 / (1 + exp(-(ln(least(greatest(c.score, 1e-7), 1 - 1e-7) / (1 - least(greatest(c.score, 1e-7), 1 - 1e-7)))
                      / b.temperature))) > coalesce(g.t, 5e-1) AS predicted
FROM preds c JOIN best_t b ON b.method = c.method LEFT JOIN gbest g ON g.method = c.method AND g.code = c.code"""))
def q_calibrated(spark, sf):
    fx, val, cells = val_cells(spark, sf)
    temps = materialize(cal.fit_temperature(cells))
    th = thresholds.tune_grid(cells.select("method", "doc_id", "code", "score"),
                              fx.truth.join(val, "doc_id", "left_semi"), ["method"], min_support=3)
    out = cal.calibrate(fx.preds, temps, th)   # every split
    return out.select("method", "doc_id", "code", F.round("score", 9).alias("score"), "predicted")
