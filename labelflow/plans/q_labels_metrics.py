"""Queries: labels, splits and evaluation over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import labels, metrics
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.sources.fixtures import HEAD_SHARE, METHODS, Fixtures


def _fx(spark, sf):
    return Fixtures(spark, sf)


# ---------------------------------------------------------------- labels
@register("label_space", with_base("", "SELECT code, idx FROM label_space"))
def q_label_space(spark, sf):
    return _fx(spark, sf).label_space


@register("truth_long", with_base("", """
SELECT DISTINCT t.doc_id, t.code FROM truth t WHERE t.code IN (SELECT code FROM label_space)"""))
def q_truth_long(spark, sf):
    fx = _fx(spark, sf)
    return labels.restrict_to_space(fx.truth, fx.label_space).select("doc_id", "code").distinct()


@register("multi_hot", with_base("", """
SELECT d.doc_id,
       CAST(sum(CASE WHEN t.code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_codes,
       string_agg(CASE WHEN t.code IS NOT NULL THEN '1' ELSE '0' END, '' ORDER BY l.code) AS y_bits
FROM documents d CROSS JOIN label_space l
LEFT JOIN truth t ON t.doc_id = d.doc_id AND t.code = l.code
GROUP BY d.doc_id"""))
def q_multi_hot(spark, sf):
    fx = _fx(spark, sf)
    mh = labels.multi_hot(fx.truth, fx.label_space, fx.table("documents", "doc_id"))
    return mh.select("doc_id",
                     F.aggregate("y", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_codes"),
                     F.array_join(F.transform("y", lambda x: x.cast("string")), "").alias("y_bits"))


@register("head_tail_codes", with_base("", """
SELECT code, CAST(count(DISTINCT doc_id) AS BIGINT) AS support,
       count(DISTINCT doc_id) >= 0.3 * (SELECT count(*) FROM documents) AS is_head
FROM truth GROUP BY code"""))
def q_head_tail(spark, sf):
    fx = _fx(spark, sf)
    n = fx.table("documents", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return labels.head_tail(fx.truth, share=HEAD_SHARE, n_docs=n)


@register("stratified_split", with_base("", "SELECT doc_id, stratum, rn, fold, split FROM splits"))
def q_split(spark, sf):
    return _fx(spark, sf).splits


@register("train_docs", with_base("", """
SELECT d.doc_id, length(d.text) AS n_chars FROM documents d JOIN splits s ON d.doc_id = s.doc_id
WHERE s.split = 'train'"""))
def q_train_docs(spark, sf):
    fx = _fx(spark, sf)
    d = labels.apply_split(fx.docs, fx.splits, "train")
    return d.select("doc_id", F.length("text").alias("n_chars"))


@register("cv_folds", with_base("", """
SELECT fold, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT stratum) AS BIGINT) AS n_strata
FROM splits WHERE split = 'train' GROUP BY fold"""))
def q_cv_folds(spark, sf):
    s = _fx(spark, sf).splits.where(F.col("split") == "train")
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n_docs"),
                                 F.countDistinct("stratum").alias("n_strata"))


@register("split_stats", with_base("""
per_doc AS (SELECT doc_id, count(*) AS k FROM truth GROUP BY doc_id),
st AS (SELECT s.split, CAST(count(*) AS BIGINT) AS n_docs,
              CAST(sum(CASE WHEN p.k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi
       FROM splits s LEFT JOIN per_doc p ON s.doc_id = p.doc_id GROUP BY s.split),
seen AS (SELECT s.split, count(DISTINCT t.code) AS n_seen FROM truth t JOIN splits s ON t.doc_id = s.doc_id
         GROUP BY s.split)""", """
SELECT st.split, st.n_docs, st.n_multi, round(CAST(st.n_multi AS DOUBLE) / st.n_docs, 6) AS multi_share,
       CAST((SELECT count(*) FROM label_space) - coalesce(seen.n_seen, 0) AS BIGINT) AS zero_support_codes
FROM st LEFT JOIN seen ON st.split = seen.split"""))
def q_split_stats(spark, sf):
    fx = _fx(spark, sf)
    return labels.split_stats(fx.truth, fx.splits, fx.label_space)


# ---------------------------------------------------------------- metrics
def _pc(fx, digits=4):
    return metrics.per_class(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, digits, METHODS)


@register("per_class", with_base("", "SELECT method, code, precision, recall, f1, support FROM per_class"))
def q_per_class(spark, sf):
    return _pc(_fx(spark, sf))


@register("per_code_f1", with_base("", """
SELECT method, code, tp, fp, fn,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM counts"""))
def q_per_code_f1(spark, sf):
    fx = _fx(spark, sf)
    c = metrics.counts(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, METHODS)
    return metrics.with_prf(c, 6).select("method", "code", "tp", "fp", "fn", "f1")


_SUMMARY_SQL = """
SELECT method,
  round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1,
  round(coalesce(avg(CASE WHEN support > 0 THEN
        CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END END), 0.0), 4) AS macro_f1,
  CAST(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_labels
FROM counts GROUP BY method"""


@register("metrics", with_base("", _SUMMARY_SQL))
def q_metrics(spark, sf):
    fx = _fx(spark, sf)
    return metrics.evaluate(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, methods=METHODS)


@register("micro_f1", with_base("", """
SELECT method, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1
FROM counts GROUP BY method"""))
def q_micro(spark, sf):
    fx = _fx(spark, sf)
    c = metrics.counts(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, METHODS)
    a = c.groupBy("method").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return a.withColumn("micro_f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@register("macro_f1", with_base("", """
SELECT method,
  round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END)
        FILTER (WHERE support > 0), 6) AS macro_f1_active,
  round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END), 6) AS macro_f1_all
FROM counts GROUP BY method"""))
def q_macro(spark, sf):
    fx = _fx(spark, sf)
    c = metrics.counts(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, METHODS)
    a = metrics.summary(c, 6, active_only=True).select("method", F.col("macro_f1").alias("macro_f1_active"))
    b = metrics.summary(c, 6, active_only=False).select("method", F.col("macro_f1").alias("macro_f1_all"))
    return a.join(b, "method")


@register("per_class_matrix", with_base("", """
SELECT a.code, a.precision AS m1_precision, a.recall AS m1_recall, a.f1 AS m1_f1, a.support AS m1_support,
       b.precision AS m2_precision, b.recall AS m2_recall, b.f1 AS m2_f1, b.support AS m2_support,
       CASE WHEN a.f1 >= b.f1 THEN 'm1' ELSE 'm2' END AS best_method
FROM (SELECT * FROM per_class WHERE method = 'm1') a JOIN (SELECT * FROM per_class WHERE method = 'm2') b
  ON a.code = b.code"""))
def q_pcm(spark, sf):
    return metrics.per_class_matrix(_pc(_fx(spark, sf)), ["m1", "m2"])


@register("best_method", with_base("", """
SELECT code, method AS best_method, f1 AS best_f1 FROM (
  SELECT code, method, f1, row_number() OVER (PARTITION BY code ORDER BY f1 DESC, method) AS r FROM per_class) x
WHERE r = 1"""))
def q_best(spark, sf):
    return metrics.best_method(_pc(_fx(spark, sf)))


@register("top_bottom_codes", with_base("""
r AS (SELECT method, code, f1,
        row_number() OVER (PARTITION BY method ORDER BY f1 DESC, code) AS rank_top,
        row_number() OVER (PARTITION BY method ORDER BY f1 ASC, code) AS rank_bottom
      FROM per_class WHERE support > 0)""", """
SELECT method, 'top' AS side, CAST(rank_top AS INT) AS rank, code, f1 FROM r WHERE rank_top <= 10
UNION ALL
SELECT method, 'bottom' AS side, CAST(rank_bottom AS INT) AS rank, code, f1 FROM r WHERE rank_bottom <= 10"""))
def q_top_bottom(spark, sf):
    r = metrics.top_bottom(_pc(_fx(spark, sf)), 10)
    return r.withColumn("rank", F.col("rank").cast("int"))


_SUBSET_SQL = """
bad AS (
  SELECT DISTINCT method, doc_id FROM (
    SELECT p.method, p.doc_id FROM preds p LEFT JOIN truth t ON p.doc_id = t.doc_id AND p.code = t.code
    WHERE p.predicted <> (t.code IS NOT NULL)) x)"""


@register("subset_accuracy", with_base(_SUBSET_SQL, """
SELECT m.method, 'all' AS grp, CAST(count(*) AS BIGINT) AS n_docs,
       round(avg(CASE WHEN b.doc_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS exact_match
FROM documents d CROSS JOIN (SELECT DISTINCT method FROM preds) m
LEFT JOIN bad b ON b.doc_id = d.doc_id AND b.method = m.method
GROUP BY m.method"""))
def q_subset_acc(spark, sf):
    fx = _fx(spark, sf)
    return metrics.subset_accuracy(fx.preds, fx.truth, fx.table("documents", "doc_id"), fx.label_space, methods=METHODS)


@register("codes_per_doc", with_base("""
k AS (SELECT method, doc_id, count(*) AS k FROM preds WHERE predicted GROUP BY method, doc_id)""", """
SELECT m.method, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN coalesce(k.k, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS docs_with_code,
       round(avg(CASE WHEN coalesce(k.k, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_with_code,
       round(avg(coalesce(k.k, 0)), 6) AS mean_codes
FROM documents d CROSS JOIN (SELECT DISTINCT method FROM preds) m
LEFT JOIN k ON k.doc_id = d.doc_id AND k.method = m.method GROUP BY m.method"""))
def q_codes_per_doc(spark, sf):
    fx = _fx(spark, sf)
    return metrics.codes_per_doc(fx.preds, fx.table("documents", "doc_id"), METHODS)


@register("pos_weights", with_base("""
pos AS (SELECT code, count(*) AS pos FROM truth GROUP BY code)""", """
SELECT l.code, CAST(coalesce(p.pos, 0) AS BIGINT) AS pos,
  round(least(greatest(CAST((SELECT count(*) FROM documents) - coalesce(p.pos, 0) AS DOUBLE)
                       / greatest(coalesce(p.pos, 0), 1), 1.0), 10.0), 6) AS pos_weight
FROM label_space l LEFT JOIN pos p ON l.code = p.code"""))
def q_pos_weights(spark, sf):
    fx = _fx(spark, sf)
    return metrics.pos_weights(fx.truth, fx.table("documents", "doc_id"), fx.label_space, 10.0)


@register("loss_by_method", with_base("""
pw AS (SELECT l.code, least(greatest(CAST((SELECT count(*) FROM documents) - coalesce(p.pos, 0) AS DOUBLE)
                       / greatest(coalesce(p.pos, 0), 1), 1.0), 10.0) AS w
       FROM label_space l LEFT JOIN (SELECT code, count(*) AS pos FROM truth GROUP BY code) p ON l.code = p.code),
c AS (SELECT p.method, least(greatest(p.score, 1e-7), 1 - 1e-7) AS q,
             CASE WHEN t.code IS NULL THEN 0.0 ELSE 1.0 END AS y, pw.w
      FROM preds p LEFT JOIN truth t ON p.doc_id = t.doc_id AND p.code = t.code JOIN pw ON pw.code = p.code)""", """
SELECT method,
  round(avg(-(w * y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce,
  round(avg(pow(1 - (y * q + (1 - y) * (1 - q)), 2.0) * -(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS focal
FROM c GROUP BY method"""))
def q_loss(spark, sf):
    fx = _fx(spark, sf)
    w = metrics.pos_weights(fx.truth, fx.table("documents", "doc_id"), fx.label_space, 10.0, digits=None)
    return metrics.loss_by_method(fx.preds.select("method", "doc_id", "code", "score"), fx.truth, w, 2.0)
