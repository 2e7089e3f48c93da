"""Routing between methods, confidence signals, escalation, disagreement,
policy tables and single-document explanations.

preds   (method, doc_id, code, score, predicted)   dense or sparse
truth   (doc_id, code)
All sweeps bucket each document once and take running sums over a few
dozen grid values, instead of one pass per grid value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators import metrics

MIN_PRECISION = 0.90
DEFAULT_AUTO = 0.50


def linspace(start: float, stop: float, num: int) -> list[float]:
    """Evenly spaced values computed as i * step + start, last = stop."""
    step = (stop - start) / (num - 1)
    vals = [i * step + start for i in range(num)]
    vals[-1] = stop
    return vals


# ---------------------------------------------------------------- features
def deed_features(preds: DataFrame) -> DataFrame:
    """O-R1: per (method, doc): top-1 code and score, top-2 score, margin,
    number predicted.  The rank window is per (method, doc): at most one row
    per label-space code."""
    w = Window.partitionBy("method", "doc_id").orderBy(F.col("score").desc(), F.col("code").asc())
    r = preds.withColumn("_r", F.row_number().over(w))
    return r.groupBy("method", "doc_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("code"))).alias("top1_code"),
        F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("top1_score"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0)).alias("top2_score"),
        F.sum(F.col("predicted").cast("int")).cast("bigint").alias("n_pred")).withColumn(
        "margin", F.col("top1_score") - F.col("top2_score"))


def _value_ranks(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each different value ``_v`` of a group once: its number ``_c``, its first
    and last rank, and the group's size and mean.

    Equal values are counted first; counts are ranked in two levels (buckets of
    the value), so neither a group nor a frequent value is gathered into one task.
    """
    g = list(group)
    counts = (values.where(F.col("_v").isNotNull()).groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_b", F.floor(F.col("_v") * 1024).cast("long")))
    whole = Window.partitionBy(*g)
    below = (counts.groupBy(*g, "_b").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_v")).alias("_t"))
             .select(*g, "_b", (F.sum("_s").over(whole.orderBy("_b")) - F.col("_s")).alias("_before"),
                     F.sum("_s").over(whole).alias("_n"), (F.sum("_t").over(whole) / F.sum("_s").over(whole)).alias("_mean")))
    inside = Window.partitionBy(*g, "_b").orderBy("_v")
    return (counts.join(below, [*g, "_b"])
            .withColumn("_last", F.col("_before") + F.sum("_c").over(inside))
            .withColumn("_first", F.col("_last") - F.col("_c") + 1))


def _quantile(q: float):
    """Aggregate over the value ranks of a group: the values at the two ranks
    around position (n - 1) * q, interpolated."""
    pos = (F.col("_n") - 1) * F.lit(float(q))

    def at(rank):
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))

    lo, hi = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
    return (lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(f"q{int(round(q * 100))}")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolated quantiles (pandas/NumPy default) per group, exact, all
    in one aggregate over the group's value ranks.  Null values do not count."""
    ranks = _value_ranks(df.select(*group, F.col(value).alias("_v")), group)
    return ranks.groupBy(*group).agg(*[_quantile(q) for q in qs])


def feature_summary(feats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-R2: per method and feature: count, mean, std (sample), min, quartiles, max.

    The features are melted to (method, feature, value) once; everything is one
    aggregate over the ranks of their different values.  Nulls do not count; a
    feature without a value has no row, one with a single value a null std."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in cols])
    ranks = _value_ranks(feats.select("method", F.explode(pairs).alias("_f")).select("method", "_f.*"), ["method", "feature"])
    off = F.col("_v") - F.col("_mean")
    n = F.sum("_c")
    return ranks.groupBy("method", "feature").agg(
        n.alias("count"), F.max("_mean").alias("mean"),
        F.when(n > 1, F.sqrt(F.sum(F.col("_c") * off * off) / (n - 1))).alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), *[_quantile(q) for q in (0.25, 0.5, 0.75)])


# ---------------------------------------------------------------- routing
def routing_map(per_class: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """O-R3: per code, method_a when F1_a >= F1_b (missing F1 = 0), else method_b."""
    a = per_class.where(F.col("method") == method_a).select("code", F.col("f1").alias("f1_a"))
    b = per_class.where(F.col("method") == method_b).select("code", F.col("f1").alias("f1_b"))
    j = a.join(b, "code", "full")
    fa, fb = F.coalesce("f1_a", F.lit(0.0)), F.coalesce("f1_b", F.lit(0.0))
    return j.select("code", fa.alias("f1_a"), fb.alias("f1_b"),
                    F.when(fa >= fb, F.lit(method_a)).otherwise(F.lit(method_b)).alias("method"))


def routed(preds: DataFrame, routing: DataFrame, name: str = "routed") -> DataFrame:
    """O-R4: per code the rows of the routed method (broadcast routing table)."""
    r = F.broadcast(routing.select("code", "method"))
    return preds.join(r, ["code", "method"], "left_semi").withColumn("method", F.lit(name))


def confidence(preds: DataFrame, n_codes: DataFrame | None = None) -> DataFrame:
    """O-R5: per (method, doc): weakest accepted score, strongest rejected
    score, gap, no_pred, n_rejected.  NULL replaces NaN / -inf.

    For sparse input pass ``n_codes`` (one row, column n_codes): a document
    with fewer stored rows than codes has unstored rejected cells (score 0).
    """
    agg = preds.groupBy("method", "doc_id").agg(
        F.min(F.when(F.col("predicted"), F.col("score"))).alias("min_pred"),
        F.max(F.when(~F.col("predicted"), F.col("score"))).alias("max_rej"),
        F.sum(F.when(F.col("predicted"), 1).otherwise(0)).alias("_np"),
        F.sum(F.when(~F.col("predicted"), 1).otherwise(0)).alias("n_rejected"),
        F.count(F.lit(1)).alias("_stored"))
    if n_codes is not None:
        agg = (agg.crossJoin(F.broadcast(n_codes))
               .withColumn("max_rej", F.when(F.col("_stored") < F.col("n_codes"),
                                             F.greatest(F.coalesce("max_rej", F.lit(0.0)), F.lit(0.0)))
                           .otherwise(F.col("max_rej")))
               .withColumn("n_rejected", F.col("n_rejected") + F.col("n_codes") - F.col("_stored"))
               .drop("n_codes"))
    return agg.select("method", "doc_id", "min_pred", "max_rej",
                      (F.col("min_pred") - F.col("max_rej")).alias("gap"),
                      (F.col("_np") == 0).alias("no_pred"), F.col("n_rejected").cast("bigint").alias("n_rejected"))


def escalate_flag(conf: DataFrame, min_score: float | str, min_gap: float | str) -> DataFrame:
    """O-R9: escalated = no_pred OR min_pred < min_score OR (rejected cells
    exist AND gap < min_gap).  Thresholds are numbers or column names."""
    ms = F.col(min_score) if isinstance(min_score, str) else F.lit(float(min_score))
    mg = F.col(min_gap) if isinstance(min_gap, str) else F.lit(float(min_gap))
    low_score = ~F.col("no_pred") & (F.col("min_pred") < ms)
    low_gap = ~F.col("no_pred") & (F.col("n_rejected") > 0) & (F.col("gap") < mg)
    return conf.withColumn("low_score", F.coalesce(low_score, F.lit(False))) \
        .withColumn("low_gap", F.coalesce(low_gap, F.lit(False))) \
        .withColumn("escalated", F.col("no_pred") | F.col("low_score") | F.col("low_gap"))


def escalation_reasons(flags: DataFrame) -> DataFrame:
    """O-R10: disjoint reasons per method: no_pred, low_score, low_gap, both, auto."""
    reason = (F.when(F.col("no_pred"), "no_pred")
              .when(F.col("low_score") & F.col("low_gap"), "both")
              .when(F.col("low_score"), "low_score")
              .when(F.col("low_gap"), "low_gap").otherwise("auto"))
    return flags.groupBy("method", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_docs"))


# ---------------------------------------------------------------- sweeps
def _cell_counts(preds: DataFrame, truth: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Per (method, doc, code) flags tp/fp/fn from sparse predicted + truth rows."""
    p = preds.where(F.col("predicted")).select("method", "doc_id", "code", F.lit(1).alias("_p"))
    t = metrics.per_method(truth.select("doc_id", "code", F.lit(1).alias("_y")), preds, methods)
    return (p.join(t, ["method", "doc_id", "code"], "full")
            .select("method", "doc_id", "code",
                    (F.col("_p").isNotNull() & F.col("_y").isNotNull()).cast("int").alias("tp"),
                    (F.col("_p").isNotNull() & F.col("_y").isNull()).cast("int").alias("fp"),
                    (F.col("_p").isNull() & F.col("_y").isNotNull()).cast("int").alias("fn")))


def _sweep(cells: DataFrame, bucketed: DataFrame, grid: Sequence[float], n_docs: DataFrame,
           n_codes: DataFrame, value_name: str, preds: DataFrame, methods: Sequence[str] | None) -> DataFrame:
    """Shared sweep: ``bucketed`` (method, doc_id, b) says a document is auto
    for grid indexes 0..b-1; aggregate tp/fp/fn per (method, b, code) once,
    spread to indexes, then coverage / micro-precision / macro-F1 (all codes)."""
    garr = F.array(*[F.lit(float(v)) for v in grid])
    bucketed = bucketed.where(F.col("b") > 0)
    per = (cells.join(bucketed, ["method", "doc_id"])
           .groupBy("method", "b", "code").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                               F.sum("fn").alias("fn")))
    per_k = (per.select("method", "code", "tp", "fp", "fn",
                        F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k"))
             .groupBy("method", "k", "code").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                                 F.sum("fn").alias("fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    by_k = per_k.groupBy("method", "k").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                            F.sum(f1).alias("_f1sum"))
    # documents per (method, b) first, then spread over the grid
    docs_k = (bucketed.groupBy("method", "b").agg(F.count(F.lit(1)).alias("n"))
              .select("method", "n", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k"))
              .groupBy("method", "k").agg(F.sum("n").alias("n_auto")))
    ks = bucketed.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("k"))
    base = metrics.per_method(ks, preds, methods)   # methods x grid: small; a method without an auto document keeps its rows
    out = (base.join(docs_k, ["method", "k"], "left").join(by_k, ["method", "k"], "left")
           .crossJoin(F.broadcast(n_docs)).crossJoin(F.broadcast(n_codes)))
    n_auto = F.coalesce("n_auto", F.lit(0))
    return out.select(
        "method", "k", garr[F.col("k")].alias(value_name),
        (n_auto / F.col("n_docs")).alias("coverage"),
        F.when(n_auto > 0, F.when(F.col("tp") + F.col("fp") > 0,
                                  F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).alias("micro_prec"),
        F.when(n_auto > 0, F.coalesce("_f1sum", F.lit(0.0)) / F.col("n_codes")).alias("macro_f1"))


def precision_coverage(preds: DataFrame, truth: DataFrame, docs: DataFrame, n_codes: DataFrame,
                       grid: Sequence[float] | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """O-R6: auto-threshold sweep (80 values 0.05..0.95): documents with a
    prediction and min_pred >= t are auto-handled.  ``methods`` names the methods
    of ``preds``; without it they are looked up there."""
    grid = list(grid or linspace(0.05, 0.95, 80))
    garr = F.array(*[F.lit(float(v)) for v in grid])
    conf = confidence(preds)
    b = conf.where(~F.col("no_pred")).select(
        "method", "doc_id", F.size(F.filter(garr, lambda t: t <= F.col("min_pred"))).alias("b"))
    cells = _cell_counts(preds.join(docs.select("doc_id"), "doc_id", "left_semi"),
                         truth.join(docs.select("doc_id"), "doc_id", "left_semi"), methods)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return _sweep(cells, b, grid, n, n_codes, "threshold", preds, methods)


def operating_point(sweep: DataFrame, min_precision: float = MIN_PRECISION,
                    default: float = DEFAULT_AUTO) -> DataFrame:
    """O-R7: per method the threshold with the highest coverage among rows with
    micro-precision >= min_precision (lowest threshold on ties), else default."""
    ok = sweep.where(F.col("micro_prec").isNotNull() & F.col("macro_f1").isNotNull()
                     & (F.col("micro_prec") >= F.lit(float(min_precision))))
    best = ok.groupBy("method").agg(F.max(F.struct(F.col("coverage"), (-F.col("threshold")).alias("nt")))
                                    .alias("b"))
    methods = sweep.select("method").distinct()
    return (methods.join(best, "method", "left")
            .select("method", F.coalesce(-F.col("b.nt"), F.lit(float(default))).alias("auto_threshold")))


def gap_sweep(preds: DataFrame, truth: DataFrame, docs: DataFrame, n_codes: DataFrame,
              auto: DataFrame, grid: Sequence[float] | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """O-R8: with the auto threshold fixed, sweep min_gap (100 values 0..0.5);
    a document stays auto unless no_pred, min_pred < auto or gap < g
    (gap = +inf when nothing is rejected)."""
    grid = list(grid or linspace(0.0, 0.5, 100))
    garr = F.array(*[F.lit(float(v)) for v in grid])
    conf = confidence(preds).join(F.broadcast(auto), "method")
    ok = conf.where(~F.col("no_pred") & (F.col("min_pred") >= F.col("auto_threshold")))
    big = F.lit(float(len(grid)))
    b = ok.select("method", "doc_id", F.when(F.col("n_rejected") == 0, big.cast("int")).otherwise(
        F.size(F.filter(garr, lambda g: g <= F.col("gap")))).alias("b"))
    cells = _cell_counts(preds.join(docs.select("doc_id"), "doc_id", "left_semi"),
                         truth.join(docs.select("doc_id"), "doc_id", "left_semi"), methods)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return _sweep(cells, b, grid, n, n_codes, "min_gap", auto, methods)


def nearest(sweep: DataFrame, col: str, target: float) -> DataFrame:
    """Row per method whose ``col`` is nearest ``target`` (first on ties)."""
    best = sweep.groupBy("method").agg(F.min(F.struct(F.abs(F.col(col) - F.lit(float(target))).alias("d"),
                                                      F.col("k"))).alias("b"))
    return sweep.join(best.select("method", F.col("b.k").alias("k")), ["method", "k"])


# ---------------------------------------------------------------- disagreement
def disagreement(preds: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """Per (doc, code) cells predicted by exactly one of two methods."""
    a = preds.where((F.col("method") == method_a) & F.col("predicted")).select("doc_id", "code", F.lit(1).alias("_a"))
    b = preds.where((F.col("method") == method_b) & F.col("predicted")).select("doc_id", "code", F.lit(1).alias("_b"))
    return a.join(b, ["doc_id", "code"], "full").where(F.col("_a").isNull() | F.col("_b").isNull()) \
        .select("doc_id", "code")


def disagreement_rate(preds: DataFrame, docs: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """O-D1: share of documents whose two predicted label sets differ."""
    d = disagreement(preds, method_a, method_b).select("doc_id").distinct().withColumn("_d", F.lit(1))
    j = docs.select("doc_id").join(d, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_docs"),
                 F.sum(F.coalesce("_d", F.lit(0))).cast("bigint").alias("n_disagree"),
                 F.round(F.avg(F.coalesce("_d", F.lit(0)).cast("double")), 6).alias("disagree_rate"))


def disagreement_by_code(preds: DataFrame, docs: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """O-D3: per code the share of documents where the methods disagree."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    d = disagreement(preds, method_a, method_b).join(docs.select("doc_id"), "doc_id", "left_semi")
    return (d.groupBy("code").agg(F.count(F.lit(1)).alias("n_disagree")).crossJoin(F.broadcast(n))
            .select("code", "n_disagree", (F.col("n_disagree") / F.col("n_docs")).alias("disagree_rate")))


def code_lists(preds: DataFrame, name: str) -> DataFrame:
    """(doc_id, ``name``) = sorted predicted codes joined by ', '."""
    return (preds.where(F.col("predicted")).groupBy("doc_id")
            .agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias(name)))


# ---------------------------------------------------------------- policy / explain
def policy_table(routing: DataFrame, dis_by_code: DataFrame, auto: DataFrame, min_gap: float,
                 method_a: str) -> DataFrame:
    """O-Y1: per code: routed method, its val F1, disagreement rate, the
    escalate flag, plus the global min_score / min_gap (one row per code)."""
    return (routing.join(dis_by_code.select("code", "disagree_rate"), "code", "left")
            .crossJoin(F.broadcast(auto.select(F.col("auto_threshold").alias("min_score"))))
            .select("code", "method",
                    F.when(F.col("method") == method_a, F.col("f1_a")).otherwise(F.col("f1_b")).alias("f1"),
                    F.round(F.coalesce("disagree_rate", F.lit(0.0)), 4).alias("disagree_rate"),
                    F.lit(True).alias("escalate_if_uncertain"), "min_score", F.lit(float(min_gap)).alias("min_gap")))


def apply_policy(preds: DataFrame, policy: DataFrame) -> DataFrame:
    """O-Y2: route by the policy's per-code method and escalate by its global
    thresholds; only codes whose ``escalate_if_uncertain`` is set can make a
    document 'low score' or 'low gap'."""
    p = preds.join(F.broadcast(policy.select("code", "method", "escalate_if_uncertain", "min_score", "min_gap")),
                   ["code", "method"])
    agg = p.groupBy("doc_id").agg(
        F.min(F.when(F.col("predicted") & F.col("escalate_if_uncertain"), F.col("score"))).alias("min_flag"),
        F.max(F.when(~F.col("predicted"), F.col("score"))).alias("max_rej"),
        (F.sum(F.when(F.col("predicted"), 1).otherwise(0)) == 0).alias("no_pred"),
        F.sum(F.when(~F.col("predicted"), 1).otherwise(0)).alias("n_rej"),
        F.max("min_score").alias("min_score"), F.max("min_gap").alias("min_gap"))
    esc = (F.col("no_pred") | F.coalesce(F.col("min_flag") < F.col("min_score"), F.lit(False))
           | F.coalesce((F.col("n_rej") > 0) & (F.col("min_flag") - F.col("max_rej") < F.col("min_gap")), F.lit(False)))
    return agg.withColumn("escalated", esc)


def explain(preds: DataFrame, routing: DataFrame, truth: DataFrame, ids: DataFrame,
            method_a: str, method_b: str, hide_below: float = 0.02) -> DataFrame:
    """O-X1/O-P11: per code of the given documents: both scores, the routed
    method, score and decision, truth; rows with routed score < ``hide_below``
    that are neither true nor predicted are hidden; ranked by routed score."""
    sel = preds.join(ids.select("doc_id"), "doc_id", "left_semi")
    pa = sel.where(F.col("method") == method_a).select("doc_id", "code", F.col("score").alias("m1_score"),
                                                        F.col("predicted").alias("_pa"))
    pb = sel.where(F.col("method") == method_b).select("doc_id", "code", F.col("score").alias("m2_score"),
                                                        F.col("predicted").alias("_pb"))
    r = F.broadcast(routing.select("code", F.col("method").alias("routed_method")))
    t = truth.select("doc_id", "code", F.lit(True).alias("_t"))
    j = pa.join(pb, ["doc_id", "code"]).join(r, "code").join(t, ["doc_id", "code"], "left")
    is_a = F.col("routed_method") == method_a
    j = j.select("doc_id", "code", "routed_method", "m1_score", "m2_score",
                 F.when(is_a, F.col("m1_score")).otherwise(F.col("m2_score")).alias("routed_score"),
                 F.when(is_a, F.col("_pa")).otherwise(F.col("_pb")).alias("predicted"),
                 F.coalesce("_t", F.lit(False)).alias("is_true"))
    j = j.where(~((F.col("routed_score") < hide_below) & ~F.col("is_true") & ~F.col("predicted")))
    w = Window.partitionBy("doc_id").orderBy(F.col("routed_score").desc(), F.col("code"))
    return j.withColumn("rank", F.row_number().over(w).cast("int"))
