"""Queries: document scan, split sizes, the prediction contract (write, read,
checks, wide form, alignment), threshold maps, quick-run sample and the
flat-vs-tuned comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import metrics, thresholds
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.session import materialize, scratch_path
from labelflow.sources import contract
from labelflow.sources.fixtures import Fixtures



def sparse_preds(fx: Fixtures):
    """The sparse score table: zero scores are not stored."""
    return fx.preds.where(F.col("score") > 0)


@register("deeds_scan", with_base("""
lab AS (SELECT doc_id, string_agg(CAST(code AS VARCHAR), ', ' ORDER BY code) AS codes
        FROM truth GROUP BY doc_id)""", """
SELECT d.doc_id, length(d.text) AS n_chars, coalesce(l.codes, '') AS codes
FROM documents d LEFT JOIN lab l ON l.doc_id = d.doc_id"""))
def q_deeds_scan(spark, sf):
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "deeds-jsonl")
    contract.write_deeds(fx.docs, fx.truth, path)
    d = contract.read_deeds(spark, path)
    return d.select("doc_id", F.length("text").alias("n_chars"),
                    F.array_join(F.array_sort("codes"), ", ").alias("codes"))


@register("split_sizes", with_base("", """
SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n_docs
FROM splits GROUP BY 1"""))
def q_split_sizes(spark, sf):
    fx = Fixtures(spark, sf)
    s = materialize(fx.splits)
    return contract.split_sizes(s.where(F.col("split") == "train"), s.where(F.col("split") == "val"))


_DENSE_SQL = """
sp AS (SELECT method, doc_id, code, score, predicted FROM preds WHERE score > 0),
dense AS (SELECT m.method, d.doc_id, l.code, CAST(coalesce(s.score, 0.0) AS FLOAT) AS score,
                 coalesce(s.predicted, false) AS predicted
          FROM (SELECT DISTINCT method FROM preds) m CROSS JOIN documents d CROSS JOIN label_space l
          LEFT JOIN sp s ON s.method = m.method AND s.doc_id = d.doc_id AND s.code = l.code)"""


@register("contract_dense", with_base(_DENSE_SQL, """
SELECT doc_id, code, score, predicted, method FROM dense WHERE method = 'm1'"""))
def q_contract_dense(spark, sf):
    fx = Fixtures(spark, sf)
    sp = sparse_preds(fx).where(F.col("method") == "m1")
    return contract.dense_contract(sp, fx.table("documents", "doc_id"), fx.label_space, "m1")


@register("contract_read", with_base(_DENSE_SQL, """
SELECT doc_id, code, score, predicted, method FROM dense WHERE method = 'm2'"""))
def q_contract_read(spark, sf):
    fx = Fixtures(spark, sf)
    root = scratch_path(spark, "contract")
    docs, space = fx.table("documents", "doc_id"), fx.label_space
    for m in ("m1", "m2"):
        sp = sparse_preds(fx).where(F.col("method") == m)
        contract.write_predictions(contract.dense_contract(sp, docs, space, m), root)
    return contract.read_predictions(spark, root, "m2")


@register("contract_violations", with_base(_DENSE_SQL + """,
bad AS (
  SELECT method, doc_id, code, CASE WHEN doc_id % 11 = 1 THEN score + 2 WHEN doc_id % 11 = 2 THEN NULL ELSE score END AS score,
         predicted FROM dense WHERE doc_id % 7 <> 3
  UNION ALL SELECT method, doc_id, code, score, predicted FROM dense WHERE doc_id % 5 = 0
  UNION ALL SELECT method, doc_id, code + 100000 AS code, score, predicted FROM dense WHERE doc_id % 13 = 4),
keys AS (SELECT method, doc_id, code, count(*) AS k FROM bad GROUP BY method, doc_id, code)""", """
SELECT b.method, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range,
       CAST(sum(CASE WHEN score IS NULL OR predicted IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_cells,
       CAST((SELECT count(*) FROM keys x WHERE x.method = b.method AND k > 1) AS BIGINT) AS duplicate_keys,
       CAST((SELECT count(*) FROM documents) * (SELECT count(*) FROM label_space)
            - (SELECT count(*) FROM keys x WHERE x.method = b.method AND x.code IN (SELECT code FROM label_space)) AS BIGINT) AS missing_cells,
       CAST(sum(CASE WHEN code NOT IN (SELECT code FROM label_space) THEN 1 ELSE 0 END) AS BIGINT) AS unknown_code_rows
FROM bad b GROUP BY b.method"""))
def q_violations(spark, sf):
    """The checks on a table with planted faults of each kind."""
    fx = Fixtures(spark, sf)
    docs, space = fx.table("documents", "doc_id"), fx.label_space
    sp = sparse_preds(fx)
    parts = [contract.dense_contract(sp.where(F.col("method") == m), docs, space, m) for m in ("m1", "m2")]
    dense = materialize(parts[0].unionByName(parts[1]))
    r = F.col("doc_id") % 11
    bad = dense.where(F.col("doc_id") % 7 != 3).withColumn(
        "score", F.when(r == 1, F.col("score") + 2).when(r == 2, F.lit(None)).otherwise(F.col("score")))
    bad = (bad.unionByName(dense.where(F.col("doc_id") % 5 == 0))
           .unionByName(dense.where(F.col("doc_id") % 13 == 4).withColumn("code", F.col("code") + 100000)))
    return contract.contract_violations(bad, docs, space)


@register("pred_wide", with_base("", """
SELECT doc_id, array_to_string(list(CAST(code AS VARCHAR) || '=' || CAST(CAST(round(score * 1e6) AS BIGINT) AS VARCHAR) ORDER BY code), ',') AS scores
FROM preds WHERE method = 'm1' GROUP BY doc_id"""))
def q_pred_wide(spark, sf):
    """The wide form, one column per code of the label space, shown as one
    string so that its columns follow the data."""
    fx = Fixtures(spark, sf)
    codes = [r["code"] for r in fx.label_space.select("code").orderBy("code").collect()]   # the columns of the result
    w = contract.pred_wide(fx.preds.where(F.col("method") == "m1"), codes)
    cells = [F.concat(F.lit(f"{c}="), F.round(F.col(str(c)) * 1e6).cast("bigint").cast("string")) for c in codes]
    return w.select("doc_id", F.concat_ws(",", *cells).alias("scores"))


@register("missing_predictions", with_base("", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM preds WHERE method = 'm2' AND predicted)"""))
def q_missing(spark, sf):
    """Documents without any accepted row of a method."""
    fx = Fixtures(spark, sf)
    sp = fx.preds.where((F.col("method") == "m2") & F.col("predicted"))
    _, missing = contract.align(sp, fx.table("documents", "doc_id"), fx.label_space)
    return missing


@register("aligned_predictions", with_base("", """
SELECT d.doc_id, l.code, coalesce(p.score, 0.0) AS score, coalesce(p.predicted, false) AS predicted
FROM documents d CROSS JOIN label_space l
LEFT JOIN preds p ON p.method = 'm2' AND p.predicted AND p.doc_id = d.doc_id AND p.code = l.code"""))
def q_aligned(spark, sf):
    fx = Fixtures(spark, sf)
    sp = fx.preds.where((F.col("method") == "m2") & F.col("predicted"))
    aligned, _ = contract.align(sp, fx.table("documents", "doc_id"), fx.label_space)
    return aligned


@register("sample_head", with_base("", """
SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT 50"""))
def q_sample(spark, sf):
    fx = Fixtures(spark, sf)
    return contract.sample_head(fx.docs, 50).select("doc_id", F.length("text").alias("n_chars"))


_EXACT_M1 = """
vd AS (SELECT doc_id FROM splits WHERE split = 'val'),
vp AS (SELECT p.doc_id, p.code, p.score FROM preds p JOIN vd ON vd.doc_id = p.doc_id WHERE p.method = 'm1'),
vt AS (SELECT t.doc_id, t.code FROM truth t JOIN vd ON vd.doc_id = t.doc_id),
per AS (SELECT s.code, s.score, count(*) AS n, count(t.doc_id) AS pos FROM vp s
        LEFT JOIN vt t ON t.doc_id = s.doc_id AND t.code = s.code WHERE s.score > 0 GROUP BY s.code, s.score),
cum AS (SELECT code, score, sum(n) OVER (PARTITION BY code ORDER BY score DESC) AS n_cum,
               sum(pos) OVER (PARTITION BY code ORDER BY score DESC) AS pos_cum FROM per),
sup AS (SELECT code, count(*) AS support FROM vt GROUP BY code),
th AS (SELECT code, threshold FROM (
  SELECT c.code, c.score AS threshold, row_number() OVER (PARTITION BY c.code
    ORDER BY CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) DESC, c.score) AS r
  FROM cum c JOIN sup s ON s.code = c.code WHERE c.pos_cum > 0 AND s.support >= 5) x WHERE r = 1)"""


def _exact_m1(fx):
    val = fx.splits.where(F.col("split") == "val").select("doc_id")
    vp = fx.preds.where(F.col("method") == "m1").join(val, "doc_id", "left_semi").select("doc_id", "code", "score")
    vt = fx.truth.join(val, "doc_id", "left_semi")
    return thresholds.tune_exact(vp, vt).where(F.col("support") >= 5)


@register("threshold_lookup", with_base(_EXACT_M1, """
SELECT l.code, coalesce(th.threshold, 5e-1) AS threshold FROM label_space l LEFT JOIN th ON th.code = l.code"""))
def q_threshold_lookup(spark, sf):
    fx = Fixtures(spark, sf)
    th = _exact_m1(fx)
    # round trip through a JSON object {"code": threshold}
    path = scratch_path(spark, "thresholds-json")
    (th.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), "threshold"))))
            .alias("value")).coalesce(1).write.mode("overwrite").text(path))
    back = contract.read_threshold_map(spark, path)
    return contract.threshold_lookup(fx.label_space, back, default=0.5)


@register("flat_vs_tuned", with_base(r"""
vd AS (SELECT doc_id FROM splits WHERE split = 'val'),
td AS (SELECT doc_id FROM splits WHERE split = 'train'),
vt AS (SELECT t.doc_id, t.code FROM truth t JOIN vd ON vd.doc_id = t.doc_id),
grid AS (SELECT CAST(range AS INT) AS k, 1e-1 + CAST(range AS DOUBLE) * 5e-2 AS t FROM range(13)),
gsup AS (SELECT code, count(*) AS support FROM vt GROUP BY code),
gk AS (SELECT p.method, p.code, g.k, g.t, count(*) AS n_pred, count(vt.doc_id) AS tp
       FROM preds p JOIN vd ON vd.doc_id = p.doc_id JOIN grid g ON p.score > g.t
       LEFT JOIN vt ON vt.doc_id = p.doc_id AND vt.code = p.code GROUP BY p.method, p.code, g.k, g.t),
gbest AS (SELECT method, code, t FROM (
   SELECT gk.method, gk.code, gk.t, CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END AS f1,
          row_number() OVER (PARTITION BY gk.method, gk.code
            ORDER BY CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END DESC, gk.k) AS r
   FROM gk JOIN gsup ON gsup.code = gk.code WHERE gsup.support >= 3) x WHERE r = 1 AND f1 > 0),
ev AS (SELECT p.method, p.doc_id, p.code, p.score > coalesce(b.t, 5e-1) AS predicted FROM preds p JOIN td ON td.doc_id = p.doc_id
         LEFT JOIN gbest b ON b.method = p.method AND b.code = p.code
       UNION ALL
       SELECT p.method || '_flat', p.doc_id, p.code, p.score > 5e-1 FROM preds p JOIN td ON td.doc_id = p.doc_id),
c AS (SELECT e.method, e.code,
        sum(CASE WHEN e.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN e.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN (NOT e.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN t.code IS NOT NULL THEN 1 ELSE 0 END) AS support
      FROM ev e LEFT JOIN truth t ON t.doc_id = e.doc_id AND t.code = e.code GROUP BY e.method, e.code)""", """
SELECT method,
  round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1,
  round(coalesce(avg(CASE WHEN support > 0 THEN
        CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END END), 0.0), 4) AS macro_f1,
  CAST(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_labels
FROM c GROUP BY method"""))
def q_flat_vs_tuned(spark, sf):
    fx = Fixtures(spark, sf)
    s = materialize(fx.splits)
    val, test = s.where(F.col("split") == "val").select("doc_id"), s.where(F.col("split") == "train").select("doc_id")
    vp = fx.preds.join(val, "doc_id", "left_semi").select("method", "doc_id", "code", "score")
    th = thresholds.tune_grid(vp, fx.truth.join(val, "doc_id", "left_semi"), ["method"], min_support=3)
    tp = fx.preds.join(test, "doc_id", "left_semi").select("method", "doc_id", "code", "score")
    tuned = thresholds.apply_thresholds(tp, th, ["method"], inclusive=False)
    flat = tp.select(F.concat("method", F.lit("_flat")).alias("method"), "doc_id", "code", "score",
                     (F.col("score") > F.lit(0.5)).alias("predicted"))
    both = tuned.select("method", "doc_id", "code", "score", "predicted").unionByName(flat)
    return metrics.evaluate(both, fx.truth, test, fx.label_space)
