"""Evaluation over the long prediction table.

All metrics need only tp / fp / fn per (method, code), so they are exact on
sparse tables: a missing (doc_id, code) cell is score 0, not predicted.
Every method is evaluated in one job (``groupBy(method, code)``).

Inputs
  preds  (method, doc_id, code, predicted[, score])   sparse or dense
  truth  (doc_id, code)                               positives only
  docs   (doc_id)                                     the evaluated documents
  space  (code[, idx])                                the label space
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_method(rows: DataFrame, preds: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """``rows`` once for each method: the named ones, which costs no pass over the
    predictions, or those that have rows in ``preds``."""
    if methods is not None:
        return rows.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return rows.crossJoin(F.broadcast(preds.select("method").distinct()))  # one row per method


def counts(preds: DataFrame, truth: DataFrame, docs: DataFrame, space: DataFrame,
           methods: Sequence[str] | None = None) -> DataFrame:
    """(method, code, tp, fp, fn, support) for every method x label-space code.

    A named method without any row gets no true or false positives."""
    t = (truth.join(F.broadcast(space.select("code")), "code", "left_semi")
         .join(docs.select("doc_id"), "doc_id", "left_semi")
         .select("doc_id", "code", F.lit(1).alias("_y")))
    p = (preds.where(F.col("predicted"))
         .join(F.broadcast(space.select("code")), "code", "left_semi")
         .join(docs.select("doc_id"), "doc_id", "left_semi")
         .select("method", "doc_id", "code"))
    pc = (p.join(t, ["doc_id", "code"], "left")
          .groupBy("method", "code")
          .agg(F.count(F.lit(1)).alias("n_pred"), F.count("_y").alias("tp")))
    sup = t.groupBy("code").agg(F.count(F.lit(1)).alias("support"))
    grid = per_method(space.select("code"), preds, methods)  # methods x codes: small
    return (grid.join(pc, ["method", "code"], "left").join(F.broadcast(sup), "code", "left")
            .select("method", "code",
                    F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                    (F.coalesce("n_pred", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fp"),
                    (F.coalesce("support", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fn"),
                    F.coalesce("support", F.lit(0)).cast("bigint").alias("support")))


def with_prf(c: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add precision, recall, f1 (zero_division = 0) to a tp/fp/fn table."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = _ratio(tp, tp + fp)
    r = _ratio(tp, tp + fn)
    f = _ratio(2 * tp, 2 * tp + fp + fn)
    if digits is not None:
        p, r, f = F.round(p, digits), F.round(r, digits), F.round(f, digits)
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def per_class(preds, truth, docs, space, digits: int | None = 4, methods: Sequence[str] | None = None) -> DataFrame:
    """O-E3/O-A8: per (method, code) precision, recall, f1, support."""
    return with_prf(counts(preds, truth, docs, space, methods), digits).select(
        "method", "code", "precision", "recall", "f1", "support")


def summary(c: DataFrame, digits: int = 4, active_only: bool = True) -> DataFrame:
    """O-E1/O-E2/O-E4: one record per method from a counts table.

    micro-F1 over all cells; macro-F1 over codes with support > 0
    (``active_only``) or over all codes.
    """
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    active = F.col("support") > 0
    macro = (F.avg(F.when(active, f1)) if active_only else F.avg(f1))
    agg = c.groupBy("method").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        macro.alias("_macro"), F.sum(F.when(active, 1).otherwise(0)).cast("bigint").alias("active_labels"))
    micro = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return agg.select("method", F.round(micro, digits).alias("micro_f1"),
                      F.round(F.coalesce("_macro", F.lit(0.0)), digits).alias("macro_f1"),
                      "active_labels")


def evaluate(preds, truth, docs, space, digits: int = 4, methods: Sequence[str] | None = None) -> DataFrame:
    """O-E4: metrics record per method (all methods in one job)."""
    return summary(counts(preds, truth, docs, space, methods), digits)


def per_class_matrix(pc: DataFrame, methods: list[str]) -> DataFrame:
    """O-E5/O-E6: wide per-code matrix with ``{method}_{metric}`` columns and
    ``best_method`` = highest F1, first method in name order on ties."""
    methods = sorted(methods)
    wide = pc.groupBy("code").pivot("method", methods).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"),
        F.first("f1").alias("f1"), F.first("support").alias("support"))
    # pivot names columns {method}_{alias}
    best = None
    for m in reversed(methods):
        cand = F.lit(m)
        if best is None:
            best = cand
        else:
            # m wins when its f1 is >= every later method's f1
            later = [F.col(f"{x}_f1") for x in methods[methods.index(m) + 1:]]
            cond = F.col(f"{m}_f1") >= F.greatest(*later) if len(later) > 1 else F.col(f"{m}_f1") >= later[0]
            best = F.when(cond, cand).otherwise(best)
    return wide.withColumn("best_method", best).orderBy("code")


def best_method(pc: DataFrame) -> DataFrame:
    """O-E6 long form: (code, best_method, best_f1), ties to the first name."""
    w = Window.partitionBy("code").orderBy(F.col("f1").desc(), F.col("method").asc())
    return (pc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("code", F.col("method").alias("best_method"), F.col("f1").alias("best_f1")))


def top_bottom(pc: DataFrame, k: int = 10) -> DataFrame:
    """O-E8: per method the k best and k weakest active codes by F1.

    The limit is the feature (a top-k report); it is evaluated per method with a
    rank window over (method) on the per-code table, which has one row per code.
    """
    a = pc.where(F.col("support") > 0)
    wt = Window.partitionBy("method").orderBy(F.col("f1").desc(), F.col("code").asc())
    wb = Window.partitionBy("method").orderBy(F.col("f1").asc(), F.col("code").asc())
    r = a.withColumn("rank_top", F.row_number().over(wt)).withColumn("rank_bottom", F.row_number().over(wb))
    top = r.where(F.col("rank_top") <= k).select("method", F.lit("top").alias("side"),
                                                  F.col("rank_top").alias("rank"), "code", "f1")
    bot = r.where(F.col("rank_bottom") <= k).select("method", F.lit("bottom").alias("side"),
                                                     F.col("rank_bottom").alias("rank"), "code", "f1")
    return top.unionByName(bot)


def subset_accuracy(preds: DataFrame, truth: DataFrame, docs: DataFrame,
                    space: DataFrame, group: DataFrame | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """O-E12: share of documents whose predicted set equals the true set.

    ``group`` (doc_id, grp) optionally splits the documents.
    Mismatches are the one-sided cells of a full outer join, counted per doc.
    """
    t = (truth.join(F.broadcast(space.select("code")), "code", "left_semi")
         .join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "code", F.lit(1).alias("_y")))
    tm = per_method(t, preds, methods)  # truth once per method (few methods)
    p = (preds.where(F.col("predicted")).join(F.broadcast(space.select("code")), "code", "left_semi")
         .join(docs.select("doc_id"), "doc_id", "left_semi").select("method", "doc_id", "code", F.lit(1).alias("_p")))
    bad = (tm.join(p, ["method", "doc_id", "code"], "full")
           .where(F.col("_y").isNull() | F.col("_p").isNull())
           .select("method", "doc_id").distinct())
    d = docs.select("doc_id")
    if group is not None:
        d = d.join(group.select("doc_id", "grp"), "doc_id")
    else:
        d = d.withColumn("grp", F.lit("all"))
    dm = per_method(d, preds, methods)
    flagged = dm.join(bad.withColumn("_bad", F.lit(1)), ["method", "doc_id"], "left")
    return flagged.groupBy("method", "grp").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg(F.when(F.col("_bad").isNull(), 1.0).otherwise(0.0)), 6).alias("exact_match"))


def codes_per_doc(preds: DataFrame, docs: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """O-A13: per method, share of documents with >= 1 code and mean codes per document."""
    k = (preds.where(F.col("predicted")).groupBy("method", "doc_id")
         .agg(F.count(F.lit(1)).alias("k")))
    d = per_method(docs.select("doc_id"), preds, methods)
    j = d.join(k, ["method", "doc_id"], "left").fillna(0, ["k"])
    return j.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).cast("bigint").alias("docs_with_code"),
        F.round(F.avg(F.when(F.col("k") > 0, 1.0).otherwise(0.0)), 6).alias("share_with_code"),
        F.round(F.avg("k"), 6).alias("mean_codes"))


def pos_weights(truth: DataFrame, docs: DataFrame, space: DataFrame, cap: float = 10.0,
                digits: int | None = 6) -> DataFrame:
    """O-A10: clip(neg / max(pos, 1), 1, cap) per code."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    pos = (truth.join(docs.select("doc_id"), "doc_id", "left_semi")
           .groupBy("code").agg(F.count(F.lit(1)).alias("pos")))
    w = F.least(F.greatest((F.col("n") - F.coalesce("pos", F.lit(0)))
                           / F.greatest(F.coalesce("pos", F.lit(0)), F.lit(1)), F.lit(1.0)), F.lit(float(cap)))
    if digits is not None:
        w = F.round(w, digits)
    return (space.select("code").join(pos, "code", "left").crossJoin(F.broadcast(n))
            .select("code", F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), w.alias("pos_weight")))


def loss_by_method(scored: DataFrame, truth: DataFrame, weights: DataFrame | None = None,
                   gamma: float = 2.0, eps: float = 1e-7) -> DataFrame:
    """O-A12: mean weighted BCE and focal loss over all dense (doc, code) cells.

    ``scored`` is dense (method, doc_id, code, score) with score a probability.
    BCE = -(w*y*ln p + (1-y) ln(1-p)); focal = (1-pt)^gamma * unweighted BCE.
    """
    t = truth.select("doc_id", "code", F.lit(1.0).alias("_y"))
    s = scored.join(t, ["doc_id", "code"], "left").withColumn("y", F.coalesce("_y", F.lit(0.0)))
    if weights is not None:
        s = s.join(F.broadcast(weights.select("code", "pos_weight")), "code", "left")
        w = F.coalesce("pos_weight", F.lit(1.0))
    else:
        w = F.lit(1.0)
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("y")
    bce_w = -(w * y * F.log(p) + (1 - y) * F.log(1 - p))
    bce = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    pt = y * p + (1 - y) * (1 - p)
    focal = F.pow(1 - pt, F.lit(float(gamma))) * bce
    return s.groupBy("method").agg(F.round(F.avg(bce_w), 6).alias("bce"),
                                   F.round(F.avg(focal), 6).alias("focal"))


def counts_by_method_docs(preds: DataFrame, truth: DataFrame, space: DataFrame) -> DataFrame:
    """tp/fp/fn/support per (method, code) where each method is evaluated on
    the documents it has rows for (variants over different document sets)."""
    md = preds.select("method", "doc_id").distinct()
    t = (truth.join(F.broadcast(space.select("code")), "code", "left_semi")
         .select("doc_id", "code", F.lit(1).alias("_y")))
    p = (preds.where(F.col("predicted")).join(F.broadcast(space.select("code")), "code", "left_semi")
         .select("method", "doc_id", "code"))
    pc = (p.join(t, ["doc_id", "code"], "left").groupBy("method", "code")
          .agg(F.count(F.lit(1)).alias("n_pred"), F.count("_y").alias("tp")))
    sup = md.join(t, "doc_id").groupBy("method", "code").agg(F.count(F.lit(1)).alias("support"))
    grid = F.broadcast(md.select("method").distinct()).crossJoin(F.broadcast(space.select("code")))
    return (grid.join(pc, ["method", "code"], "left").join(sup, ["method", "code"], "left")
            .select("method", "code",
                    F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                    (F.coalesce("n_pred", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fp"),
                    (F.coalesce("support", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fn"),
                    F.coalesce("support", F.lit(0)).cast("bigint").alias("support")))
