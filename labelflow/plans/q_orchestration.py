"""Queries: routing, confidence, sweeps, escalation, disagreement, policy,
explanations and the ablation over the two fixture methods.

Routing and the sweeps are fitted on the val split and applied to the train
split, which plays the part of the held-out set here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from labelflow.operators import metrics, orchestrate as orc
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.session import materialize, reuse
from labelflow.sources.fixtures import Fixtures

A, B = "m1", "m2"
MIN_GAP = 0.1


class Orchestrated:
    def __init__(self, spark, sf):
        self.fx = Fixtures(spark, sf)
        self.splits = materialize(self.fx.splits)
        self.preds = self.fx.preds
        self.truth = self.fx.truth
        self.space = self.fx.label_space
        self.n_codes = self.space.agg(F.count(F.lit(1)).alias("n_codes"))

    def docs(self, split):
        return self.splits.where(F.col("split") == split).select("doc_id")

    def preds_in(self, split):
        return self.preds.join(self.docs(split), "doc_id", "left_semi")

    @cached_property
    def val_per_class(self):
        return metrics.per_class(self.preds_in("val"), self.truth, self.docs("val"), self.space, methods=(A, B))

    @cached_property
    def routing(self):
        return materialize(orc.routing_map(self.val_per_class, A, B))

    def routed(self, split):
        return orc.routed(self.preds_in(split), self.routing)

    @cached_property
    def sweep(self):
        return orc.precision_coverage(self.routed("val"), self.truth, self.docs("val"), self.n_codes, methods=["routed"])

    @cached_property
    def auto(self):
        return materialize(orc.operating_point(self.sweep))

    @cached_property
    def flags(self):
        conf = orc.confidence(self.routed("train")).join(F.broadcast(self.auto), "method")
        return materialize(orc.escalate_flag(conf, "auto_threshold", MIN_GAP))

    @property
    def orchestration(self):
        esc = self.flags.select("doc_id", "escalated")
        return (self.routed("train").join(esc, "doc_id", "left")
                .select(F.lit("orchestration").alias("method"), "doc_id", "code", "score",
                        (F.col("predicted") & ~F.coalesce("escalated", F.lit(False))).alias("predicted")))


ORCH_CTES = r"""
vdocs AS (SELECT doc_id FROM splits WHERE split = 'val'),
tdocs AS (SELECT doc_id FROM splits WHERE split = 'train'),
vcounts AS (
  SELECT p.method, p.code,
         sum(CASE WHEN p.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN (NOT p.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS fn
  FROM preds p JOIN vdocs d ON d.doc_id = p.doc_id LEFT JOIN truth t ON p.doc_id = t.doc_id AND p.code = t.code
  GROUP BY p.method, p.code),
vpc AS (SELECT method, code,
          round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1
        FROM vcounts),
routing AS (SELECT a.code, a.f1 AS f1_a, b.f1 AS f1_b, CASE WHEN a.f1 >= b.f1 THEN 'm1' ELSE 'm2' END AS method
            FROM vpc a JOIN vpc b ON a.code = b.code AND a.method = 'm1' AND b.method = 'm2'),
rall AS (SELECT p.doc_id, p.code, p.score, p.predicted FROM preds p JOIN routing r ON r.code = p.code AND r.method = p.method),
rt AS (SELECT * FROM rall WHERE doc_id IN (SELECT doc_id FROM tdocs)),
rv AS (SELECT * FROM rall WHERE doc_id IN (SELECT doc_id FROM vdocs)),
conf_t AS (SELECT doc_id, min(CASE WHEN predicted THEN score END) AS min_pred,
                  max(CASE WHEN NOT predicted THEN score END) AS max_rej,
                  sum(CASE WHEN predicted THEN 1 ELSE 0 END) = 0 AS no_pred,
                  CAST(sum(CASE WHEN NOT predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected FROM rt GROUP BY doc_id),
conf_v AS (SELECT doc_id, min(CASE WHEN predicted THEN score END) AS min_pred,
                  max(CASE WHEN NOT predicted THEN score END) AS max_rej,
                  sum(CASE WHEN predicted THEN 1 ELSE 0 END) = 0 AS no_pred,
                  CAST(sum(CASE WHEN NOT predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected FROM rv GROUP BY doc_id),
ncodes AS (SELECT count(*) AS c FROM label_space),
vcells AS (SELECT r.doc_id, r.code,
             CASE WHEN r.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END AS tp,
             CASE WHEN r.predicted AND t.code IS NULL THEN 1 ELSE 0 END AS fp,
             CASE WHEN (NOT r.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END AS fn
           FROM rv r LEFT JOIN truth t ON t.doc_id = r.doc_id AND t.code = r.code),
g80 AS (SELECT CAST(range AS INT) AS k,
          CASE WHEN range = 79 THEN 95e-2 ELSE CAST(range AS DOUBLE) * ((95e-2 - 5e-2) / 79) + 5e-2 END AS t FROM range(80)),
pc_auto AS (SELECT g.k, g.t, v.doc_id FROM g80 g JOIN conf_v v ON (NOT v.no_pred) AND v.min_pred >= g.t),
pc_code AS (SELECT a.k, c.code, sum(c.tp) AS tp, sum(c.fp) AS fp, sum(c.fn) AS fn
            FROM pc_auto a JOIN vcells c ON c.doc_id = a.doc_id GROUP BY a.k, c.code),
pc_k AS (SELECT k, sum(tp) AS tp, sum(fp) AS fp,
           sum(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END) AS f1sum
         FROM pc_code GROUP BY k),
pc_n AS (SELECT g.k, g.t, count(a.doc_id) AS n_auto FROM g80 g LEFT JOIN pc_auto a ON a.k = g.k GROUP BY g.k, g.t),
pc AS (SELECT n.k, n.t AS threshold, CAST(n.n_auto AS DOUBLE) / (SELECT count(*) FROM vdocs) AS coverage,
         CASE WHEN n.n_auto > 0 THEN CASE WHEN s.tp + s.fp > 0 THEN CAST(s.tp AS DOUBLE) / (s.tp + s.fp) ELSE 0.0 END END
           AS micro_prec,
         CASE WHEN n.n_auto > 0 THEN coalesce(s.f1sum, 0.0) / (SELECT c FROM ncodes) END AS macro_f1
       FROM pc_n n LEFT JOIN pc_k s ON s.k = n.k),
op AS (SELECT coalesce((SELECT threshold FROM pc WHERE micro_prec IS NOT NULL AND macro_f1 IS NOT NULL
                        AND micro_prec >= 9e-1 ORDER BY coverage DESC, threshold ASC LIMIT 1), 5e-1) AS auto_threshold),
flags AS (SELECT c.doc_id, c.no_pred,
            coalesce((NOT c.no_pred) AND c.min_pred < o.auto_threshold, false) AS low_score,
            coalesce((NOT c.no_pred) AND c.n_rejected > 0 AND (c.min_pred - c.max_rej) < 1e-1, false) AS low_gap
          FROM conf_t c, op o),
esc AS (SELECT doc_id, no_pred, low_score, low_gap, no_pred OR low_score OR low_gap AS escalated FROM flags),
orch AS (SELECT r.doc_id, r.code, r.score, r.predicted AND NOT e.escalated AS predicted
         FROM rt r JOIN esc e ON e.doc_id = r.doc_id),
dis AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.code, b.code) AS code FROM
          (SELECT doc_id, code FROM preds WHERE method = 'm1' AND predicted AND doc_id IN (SELECT doc_id FROM tdocs)) a
          FULL JOIN (SELECT doc_id, code FROM preds WHERE method = 'm2' AND predicted AND doc_id IN (SELECT doc_id FROM tdocs)) b
          ON a.doc_id = b.doc_id AND a.code = b.code WHERE a.doc_id IS NULL OR b.doc_id IS NULL)
"""


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("deed_features", with_base(ORCH_CTES, """
SELECT method, doc_id, max(CASE WHEN r = 1 THEN code END) AS top1_code,
       round(max(CASE WHEN r = 1 THEN score END), 9) AS top1_score,
       round(coalesce(max(CASE WHEN r = 2 THEN score END), 0.0), 9) AS top2_score,
       CAST(sum(CASE WHEN predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_pred,
       round(max(CASE WHEN r = 1 THEN score END) - coalesce(max(CASE WHEN r = 2 THEN score END), 0.0), 9) AS margin
FROM (SELECT p.*, row_number() OVER (PARTITION BY method, doc_id ORDER BY score DESC, code) AS r
      FROM preds p WHERE doc_id IN (SELECT doc_id FROM tdocs)) x GROUP BY method, doc_id"""))
def q_features(spark, sf):
    o = Orchestrated(spark, sf)
    f = orc.deed_features(o.preds_in("train"))
    return f.select("method", "doc_id", "top1_code", *[F.round(c, 9).alias(c) for c in
                                                        ("top1_score", "top2_score")], "n_pred",
                    F.round("margin", 9).alias("margin"))


@register("feature_summary", with_base(ORCH_CTES + """,
feat AS (SELECT method, doc_id, max(CASE WHEN r = 1 THEN score END) AS top1_score,
           max(CASE WHEN r = 1 THEN score END) - coalesce(max(CASE WHEN r = 2 THEN score END), 0.0) AS margin,
           CAST(sum(CASE WHEN predicted THEN 1 ELSE 0 END) AS DOUBLE) AS n_pred
         FROM (SELECT p.*, row_number() OVER (PARTITION BY method, doc_id ORDER BY score DESC, code) AS r
               FROM preds p WHERE doc_id IN (SELECT doc_id FROM tdocs)) x GROUP BY method, doc_id),
lf AS (SELECT method, 'top1_score' AS feature, top1_score AS v FROM feat
       UNION ALL SELECT method, 'margin', margin FROM feat UNION ALL SELECT method, 'n_pred', n_pred FROM feat)""", """
SELECT method, feature, CAST(count(v) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
       round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
FROM lf GROUP BY method, feature"""))
def q_feature_summary(spark, sf):
    o = Orchestrated(spark, sf)
    f = orc.deed_features(o.preds_in("train")).withColumn("n_pred", F.col("n_pred").cast("double"))
    s = orc.feature_summary(f, ["top1_score", "margin", "n_pred"])
    return s.select("method", "feature", "count", *_r6("mean", "std", "min", "q25", "q50", "q75", "max"))


@register("routing_map", with_base(ORCH_CTES, "SELECT code, f1_a, f1_b, method FROM routing"))
def q_routing(spark, sf):
    return Orchestrated(spark, sf).routing


@register("routed_preds", with_base(ORCH_CTES, "SELECT doc_id, code, score, predicted FROM rt"))
def q_routed(spark, sf):
    return Orchestrated(spark, sf).routed("train").select("doc_id", "code", "score", "predicted")


@register("deed_confidence", with_base(ORCH_CTES, """
SELECT doc_id, round(min_pred, 9) AS min_pred, round(max_rej, 9) AS max_rej,
       round(min_pred - max_rej, 9) AS gap, no_pred, n_rejected FROM conf_t"""))
def q_conf(spark, sf):
    c = orc.confidence(Orchestrated(spark, sf).routed("train"))
    return c.select("doc_id", *[F.round(x, 9).alias(x) for x in ("min_pred", "max_rej", "gap")],
                    "no_pred", "n_rejected")


@register("precision_coverage", with_base(ORCH_CTES, """
SELECT k, threshold, round(coverage, 6) AS coverage, round(micro_prec, 6) AS micro_prec,
       round(macro_f1, 6) AS macro_f1 FROM pc"""))
def q_pc(spark, sf):
    s = Orchestrated(spark, sf).sweep
    return s.select("k", "threshold", *_r6("coverage", "micro_prec", "macro_f1"))


@register("operating_point", with_base(ORCH_CTES, "SELECT auto_threshold FROM op"))
def q_op(spark, sf):
    return Orchestrated(spark, sf).auto.select("auto_threshold")


_GAP_SQL = r""",
g100 AS (SELECT CAST(range AS INT) AS k,
           CASE WHEN range = 99 THEN 5e-1 ELSE CAST(range AS DOUBLE) * ((5e-1 - 0e0) / 99) + 0e0 END AS g FROM range(100)),
gs_auto AS (SELECT g.k, v.doc_id FROM g100 g JOIN conf_v v ON (NOT v.no_pred)
              AND v.min_pred >= (SELECT auto_threshold FROM op)
              AND (v.n_rejected = 0 OR v.min_pred - v.max_rej >= g.g)),
gs_code AS (SELECT a.k, c.code, sum(c.tp) AS tp, sum(c.fp) AS fp, sum(c.fn) AS fn
            FROM gs_auto a JOIN vcells c ON c.doc_id = a.doc_id GROUP BY a.k, c.code),
gs_k AS (SELECT k, sum(tp) AS tp, sum(fp) AS fp,
           sum(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END) AS f1sum
         FROM gs_code GROUP BY k),
gs_n AS (SELECT g.k, g.g, count(a.doc_id) AS n_auto FROM g100 g LEFT JOIN gs_auto a ON a.k = g.k GROUP BY g.k, g.g)"""
_GAP_SELECT = """
SELECT n.k, n.g AS min_gap, round(CAST(n.n_auto AS DOUBLE) / (SELECT count(*) FROM vdocs), 6) AS coverage,
       round(CASE WHEN n.n_auto > 0 THEN CASE WHEN s.tp + s.fp > 0 THEN CAST(s.tp AS DOUBLE) / (s.tp + s.fp) ELSE 0.0 END END, 6)
         AS micro_prec,
       round(CASE WHEN n.n_auto > 0 THEN coalesce(s.f1sum, 0.0) / (SELECT c FROM ncodes) END, 6) AS macro_f1
FROM gs_n n LEFT JOIN gs_k s ON s.k = n.k"""


def _gap_sweep(spark, sf):
    o = Orchestrated(spark, sf)
    return orc.gap_sweep(o.routed("val"), o.truth, o.docs("val"), o.n_codes, o.auto.withColumn("method", F.lit("routed")),
                         methods=["routed"])


@register("gap_sweep", with_base(ORCH_CTES + _GAP_SQL, _GAP_SELECT))
def q_gap(spark, sf):
    return _gap_sweep(spark, sf).select("k", "min_gap", *_r6("coverage", "micro_prec", "macro_f1"))


@register("gap_at_policy", with_base(ORCH_CTES + _GAP_SQL, f"""
SELECT * FROM ({_GAP_SELECT}) x ORDER BY abs(min_gap - 1e-1), k LIMIT 1"""))
def q_gap_at(spark, sf):
    """The row of the gap sweep nearest to the policy's gap."""
    return (orc.nearest(materialize(_gap_sweep(spark, sf)), "min_gap", MIN_GAP)
            .select("k", "min_gap", *_r6("coverage", "micro_prec", "macro_f1")))


@register("escalated", with_base(ORCH_CTES, "SELECT doc_id, no_pred, low_score, low_gap, escalated FROM esc"))
def q_escalated(spark, sf):
    return Orchestrated(spark, sf).flags.select("doc_id", "no_pred", "low_score", "low_gap", "escalated")


@register("escalation_reasons", with_base(ORCH_CTES, """
SELECT CASE WHEN no_pred THEN 'no_pred' WHEN low_score AND low_gap THEN 'both' WHEN low_score THEN 'low_score'
            WHEN low_gap THEN 'low_gap' ELSE 'auto' END AS reason, CAST(count(*) AS BIGINT) AS n_docs
FROM esc GROUP BY 1"""))
def q_reasons(spark, sf):
    return orc.escalation_reasons(Orchestrated(spark, sf).flags).select("reason", "n_docs")


@register("orchestration_contract", with_base(ORCH_CTES, """
SELECT 'orchestration' AS method, doc_id, code, CAST(score AS FLOAT) AS score, predicted FROM orch"""))
def q_orch_contract(spark, sf):
    o = Orchestrated(spark, sf).orchestration
    return o.select("method", "doc_id", "code", F.col("score").cast("float").alias("score"), "predicted")


_ABL_SQL = """,
abl_preds AS (
  SELECT method, doc_id, code, predicted FROM preds WHERE doc_id IN (SELECT doc_id FROM tdocs)
  UNION ALL SELECT 'routed', doc_id, code, predicted FROM rt
  UNION ALL SELECT 'orchestration', doc_id, code, predicted FROM orch
  UNION ALL SELECT 'routed_auto', doc_id, code, predicted FROM rt
    WHERE doc_id IN (SELECT doc_id FROM esc WHERE NOT escalated)),
abl_docs AS (SELECT DISTINCT method, doc_id FROM abl_preds),
abl_counts AS (
  SELECT d.method, l.code,
    sum(CASE WHEN p.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN p.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN (NOT p.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS fn,
    sum(CASE WHEN t.code IS NOT NULL THEN 1 ELSE 0 END) AS support
  FROM abl_docs d CROSS JOIN label_space l
  LEFT JOIN abl_preds p ON p.method = d.method AND p.doc_id = d.doc_id AND p.code = l.code
  LEFT JOIN truth t ON t.doc_id = d.doc_id AND t.code = l.code
  GROUP BY d.method, l.code),
abl AS (
  SELECT method,
    round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1,
    round(coalesce(avg(CASE WHEN support > 0 THEN
        CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END END), 0.0), 4) AS macro_f1,
    CAST(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_labels
  FROM abl_counts GROUP BY method)"""


@register("ablation", with_base(ORCH_CTES + _ABL_SQL, """
SELECT a.method, a.micro_f1, a.macro_f1, a.active_labels,
       round(a.micro_f1 - b.micro_f1, 4) AS delta_micro_vs_m1, round(a.macro_f1 - b.macro_f1, 4) AS delta_macro_vs_m1
FROM abl a CROSS JOIN (SELECT * FROM abl WHERE method = 'm1') b"""))
def q_ablation(spark, sf):
    o = Orchestrated(spark, sf)
    test = o.docs("train")
    auto_ids = o.flags.where(~F.col("escalated")).select("doc_id")
    variants = (o.preds_in("train").select("method", "doc_id", "code", "predicted")
                .unionByName(o.routed("train").select("method", "doc_id", "code", "predicted"))
                .unionByName(o.orchestration.select("method", "doc_id", "code", "predicted"))
                .unionByName(o.routed("train").join(auto_ids, "doc_id", "left_semi")
                             .select(F.lit("routed_auto").alias("method"), "doc_id", "code", "predicted")))
    # every variant is evaluated on its own documents: one job, grouped by method
    c = metrics.counts_by_method_docs(variants, o.truth, o.space)
    m = metrics.summary(c, 4)
    base = m.where(F.col("method") == A).select(F.col("micro_f1").alias("_b_micro"),
                                                F.col("macro_f1").alias("_b_macro"))
    del test
    return m.crossJoin(F.broadcast(base)).select(
        "method", "micro_f1", "macro_f1", "active_labels",
        F.round(F.col("micro_f1") - F.col("_b_micro"), 4).alias("delta_micro_vs_m1"),
        F.round(F.col("macro_f1") - F.col("_b_macro"), 4).alias("delta_macro_vs_m1"))


@register("disagreement_rate", with_base(ORCH_CTES, """
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(d.doc_id) AS BIGINT) AS n_disagree,
       round(CAST(count(d.doc_id) AS DOUBLE) / count(*), 6) AS disagree_rate
FROM tdocs t LEFT JOIN (SELECT DISTINCT doc_id FROM dis) d ON d.doc_id = t.doc_id"""))
def q_dis_rate(spark, sf):
    o = Orchestrated(spark, sf)
    return orc.disagreement_rate(o.preds_in("train"), o.docs("train"), A, B)


@register("disagreement_errors", with_base(ORCH_CTES + """,
bad AS (SELECT DISTINCT r.doc_id FROM rt r LEFT JOIN truth t ON t.doc_id = r.doc_id AND t.code = r.code
        WHERE r.predicted <> (t.code IS NOT NULL))""", """
SELECT d.doc_id IS NOT NULL AS disagree, CAST(count(*) AS BIGINT) AS n_docs,
       round(avg(CASE WHEN b.doc_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS exact_match
FROM tdocs t LEFT JOIN (SELECT DISTINCT doc_id FROM dis) d ON d.doc_id = t.doc_id
LEFT JOIN bad b ON b.doc_id = t.doc_id GROUP BY 1"""))
def q_dis_err(spark, sf):
    o = Orchestrated(spark, sf)
    dis = orc.disagreement(o.preds_in("train"), A, B).select("doc_id").distinct()
    grp = o.docs("train").join(dis.withColumn("_d", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.coalesce("_d", F.lit(False)).alias("grp"))
    acc = metrics.subset_accuracy(o.routed("train"), o.truth, o.docs("train"), o.space, group=grp, methods=["routed"])
    return acc.select(F.col("grp").alias("disagree"), "n_docs", "exact_match")


@register("disagreement_by_code", with_base(ORCH_CTES, """
SELECT code, CAST(count(*) AS BIGINT) AS n_disagree, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tdocs), 6)
       AS disagree_rate FROM dis GROUP BY code"""))
def q_dis_code(spark, sf):
    o = Orchestrated(spark, sf)
    d = orc.disagreement_by_code(o.preds_in("train"), o.docs("train"), A, B)
    return d.select("code", "n_disagree", F.round("disagree_rate", 6).alias("disagree_rate"))


@register("disagreement_instances", with_base(ORCH_CTES + """,
lists AS (SELECT doc_id,
   array_to_string(list_sort(list(code) FILTER (WHERE src = 't')), ', ') AS true_codes,
   array_to_string(list_sort(list(code) FILTER (WHERE src = 'a')), ', ') AS m1_codes,
   array_to_string(list_sort(list(code) FILTER (WHERE src = 'b')), ', ') AS m2_codes,
   array_to_string(list_sort(list(code) FILTER (WHERE src = 'r')), ', ') AS routed_codes,
   array_to_string(list_sort(list(code) FILTER (WHERE src = 'd')), ', ') AS disagreeing_on
 FROM (SELECT doc_id, code, 't' AS src FROM truth UNION ALL
       SELECT doc_id, code, 'a' FROM preds WHERE method = 'm1' AND predicted UNION ALL
       SELECT doc_id, code, 'b' FROM preds WHERE method = 'm2' AND predicted UNION ALL
       SELECT doc_id, code, 'r' FROM rt WHERE predicted UNION ALL
       SELECT doc_id, code, 'd' FROM dis) x
 WHERE doc_id IN (SELECT doc_id FROM dis) GROUP BY doc_id)""", """
SELECT l.doc_id, coalesce(l.true_codes, '') AS true_codes, coalesce(l.m1_codes, '') AS m1_codes,
       coalesce(l.m2_codes, '') AS m2_codes, coalesce(l.routed_codes, '') AS routed_codes, l.disagreeing_on,
       e.escalated, coalesce(l.routed_codes, '') = coalesce(l.true_codes, '') AS routed_correct
FROM lists l JOIN esc e ON e.doc_id = l.doc_id"""))
def q_dis_inst(spark, sf):
    o = Orchestrated(spark, sf)
    dis = orc.disagreement(o.preds_in("train"), A, B)
    ids = dis.select("doc_id").distinct()
    pa = o.preds_in("train")
    lists = [
        orc.code_lists(o.truth.withColumn("predicted", F.lit(True)), "true_codes"),
        orc.code_lists(pa.where(F.col("method") == A), "m1_codes"),
        orc.code_lists(pa.where(F.col("method") == B), "m2_codes"),
        orc.code_lists(o.routed("train"), "routed_codes"),
        orc.code_lists(dis.withColumn("predicted", F.lit(True)), "disagreeing_on"),
    ]
    out = ids
    for lst in lists:
        out = out.join(lst, "doc_id", "left")
    out = out.join(o.flags.select("doc_id", "escalated"), "doc_id")
    cols = ["true_codes", "m1_codes", "m2_codes", "routed_codes"]
    out = out.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in cols], "disagreeing_on", "escalated")
    return out.withColumn("routed_correct", F.col("routed_codes") == F.col("true_codes"))


_POLICY_SQL = """,
dcode AS (SELECT code, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tdocs) AS rate FROM dis GROUP BY code),
policy AS (SELECT r.code, r.method, CASE WHEN r.method = 'm1' THEN r.f1_a ELSE r.f1_b END AS f1,
             round(coalesce(d.rate, 0.0), 4) AS disagree_rate, true AS escalate_if_uncertain,
             (SELECT auto_threshold FROM op) AS min_score, 1e-1 AS min_gap
           FROM routing r LEFT JOIN dcode d ON d.code = r.code)"""


def _policy(o: Orchestrated):
    dcode = orc.disagreement_by_code(o.preds_in("train"), o.docs("train"), A, B)
    return orc.policy_table(o.routing, dcode, o.auto, MIN_GAP, A)


@register("policy_table", with_base(ORCH_CTES + _POLICY_SQL, "SELECT * FROM policy"))
def q_policy(spark, sf):
    return _policy(Orchestrated(spark, sf))


@register("apply_policy", with_base(ORCH_CTES + _POLICY_SQL + """,
pol AS (SELECT code, method, disagree_rate < 2e-1 AS escalate_if_uncertain, min_score, min_gap FROM policy),
prt AS (SELECT p.doc_id, p.code, p.score, p.predicted, q.escalate_if_uncertain, q.min_score, q.min_gap
        FROM preds p JOIN pol q ON q.code = p.code AND q.method = p.method WHERE p.doc_id IN (SELECT doc_id FROM tdocs)),
pconf AS (SELECT doc_id, min(CASE WHEN predicted AND escalate_if_uncertain THEN score END) AS min_flag,
            max(CASE WHEN NOT predicted THEN score END) AS max_rej,
            sum(CASE WHEN predicted THEN 1 ELSE 0 END) = 0 AS no_pred,
            sum(CASE WHEN NOT predicted THEN 1 ELSE 0 END) AS n_rej, max(min_score) AS min_score, max(min_gap) AS min_gap
          FROM prt GROUP BY doc_id)""", """
SELECT doc_id, no_pred OR coalesce(min_flag < min_score, false)
                OR coalesce(n_rej > 0 AND min_flag - max_rej < min_gap, false) AS escalated
FROM pconf"""))
def q_apply_policy(spark, sf):
    o = Orchestrated(spark, sf)
    # an edited policy: codes with a high disagreement rate no longer trigger escalation
    pol = _policy(o).withColumn("escalate_if_uncertain", F.col("disagree_rate") < F.lit(0.2))
    return orc.apply_policy(o.preds_in("train"), pol).select("doc_id", "escalated")


@register("explain_deed", with_base(ORCH_CTES + """,
ex AS (SELECT a.doc_id, a.code, r.method AS routed_method, a.score AS m1_score, b.score AS m2_score,
         CASE WHEN r.method = 'm1' THEN a.score ELSE b.score END AS routed_score,
         CASE WHEN r.method = 'm1' THEN a.predicted ELSE b.predicted END AS predicted,
         t.code IS NOT NULL AS is_true
       FROM preds a JOIN preds b ON b.doc_id = a.doc_id AND b.code = a.code AND b.method = 'm2'
       JOIN routing r ON r.code = a.code LEFT JOIN truth t ON t.doc_id = a.doc_id AND t.code = a.code
       WHERE a.method = 'm1' AND a.doc_id IN (SELECT doc_id FROM esc WHERE escalated))""", """
SELECT doc_id, code, routed_method, round(m1_score, 9) AS m1_score, round(m2_score, 9) AS m2_score,
       round(routed_score, 9) AS routed_score, predicted, is_true,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY routed_score DESC, code) AS INT) AS rank
FROM ex WHERE NOT (routed_score < 2e-2 AND NOT is_true AND NOT predicted)"""))
def q_explain(spark, sf):
    o = Orchestrated(spark, sf)
    ids = o.flags.where(F.col("escalated")).select("doc_id")
    e = orc.explain(o.preds, o.routing, o.truth, ids, A, B)
    return e.select("doc_id", "code", "routed_method",
                    *[F.round(c, 9).alias(c) for c in ("m1_score", "m2_score", "routed_score")],
                    "predicted", "is_true", "rank")


@register("metrics_auto", with_base(ORCH_CTES + """,
auto_docs AS (SELECT doc_id FROM esc WHERE NOT escalated),
ac AS (SELECT r.code,
         sum(CASE WHEN r.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN r.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN (NOT r.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN t.code IS NOT NULL THEN 1 ELSE 0 END) AS support
       FROM rt r JOIN auto_docs a ON a.doc_id = r.doc_id LEFT JOIN truth t ON t.doc_id = r.doc_id AND t.code = r.code
       GROUP BY r.code)""", """
SELECT 'routed' AS method,
  round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1,
  round(coalesce(avg(CASE WHEN support > 0 THEN
        CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END END), 0.0), 4) AS macro_f1,
  CAST(sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_labels
FROM ac"""))
def q_metrics_auto(spark, sf):
    o = Orchestrated(spark, sf)
    auto_ids = o.flags.where(~F.col("escalated")).select("doc_id")
    return metrics.evaluate(o.routed("train"), o.truth, auto_ids, o.space, methods=["routed"])
