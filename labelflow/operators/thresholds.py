"""Per-code decision thresholds: exact search, grid search, application and
cross-validated predictions.

Scores are sparse long rows ``(*groups, doc_id, code, score)``; truth is
``(*groups?, doc_id, code)`` over the same documents.  A missing score is 0
and never predicted (the exact search skips zero scores and the grid starts
above 0), so both searches are exact on sparse data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions.ranking import running_totals_desc, score_bucket

GRID_START, GRID_STOP, GRID_STEP = 0.1, 0.75, 0.05   # 13 values 0.10 .. 0.70


def grid_values(start=GRID_START, stop=GRID_STOP, step=GRID_STEP) -> list[float]:
    vals, k = [], 0
    while start + k * step < stop:
        vals.append(start + k * step)
        k += 1
    return vals


def _support(truth: DataFrame, groups: Sequence[str]) -> DataFrame:
    return truth.groupBy(*groups, "code").agg(F.count(F.lit(1)).alias("support"))


def tune_exact(scores: DataFrame, truth: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """O-A4: per (groups, code) the threshold t among the distinct positive
    scores that maximises F1 of ``score >= t``; ties go to the lowest t.

    Output (groups, code, threshold, f1, support); codes with no positive
    document or no positive score are absent (= never predicted).
    Running sums are taken in two levels (score buckets, then inside a
    bucket) so a head code with millions of distinct scores is still spread
    over many tasks; the final pick is a plain aggregate.
    """
    g = list(groups)
    tg = [c for c in g if c in truth.columns]   # groups the truth table carries
    return _pick(_score_counts(scores, truth, g, tg), _support(truth, tg), g, tg)


def _score_counts(scores: DataFrame, truth: DataFrame, g: list[str], tg: list[str]) -> DataFrame:
    """(groups, code, score, n, pos): rows and positives of each distinct score."""
    y = truth.select(*tg, "doc_id", "code", F.lit(1).alias("_y"))
    s = scores.where(F.col("score") > 0).join(y, [*tg, "doc_id", "code"], "left")
    return s.groupBy(*g, "code", "score").agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("pos"))


def _pick(per: DataFrame, support: DataFrame, g: list[str], tg: list[str]) -> DataFrame:
    cum = running_totals_desc(per, [*g, "code"], "score", ["n", "pos"], score_bucket("score"))
    cand = cum.join(support, [*tg, "code"]).where(F.col("pos_cum") > 0)
    f1 = 2 * F.col("pos_cum") / (F.col("n_cum") + F.col("support"))
    best = cand.groupBy(*g, "code", "support").agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_t"))).alias("b"))
    return best.select(*g, "code", (-F.col("b.neg_t")).alias("threshold"), F.col("b.f1").alias("f1"),
                       "support")


def tune_grid(scores: DataFrame, truth: DataFrame, groups: Sequence[str] = (),
              min_support: int = 1, default: float = 0.5, grid: Sequence[float] | None = None,
              codes: DataFrame | None = None) -> DataFrame:
    """O-A5: per (groups, code) the grid value t with the best F1 of
    ``score > t`` (first t wins ties); ``default`` when support < min_support
    or no t reaches F1 > 0.

    Each score is bucketed once (how many grid values it exceeds), so the
    sweep is a (code, bucket) count table, not one pass per grid value.
    """
    g = list(groups)
    gv = list(grid or grid_values())
    garr = F.array(*[F.lit(float(v)) for v in gv])
    tg = [c for c in g if c in truth.columns]
    y = truth.select(*tg, "doc_id", "code", F.lit(1).alias("_y"))
    s = scores.join(y, [*tg, "doc_id", "code"], "left")
    b = F.size(F.filter(garr, lambda t: F.col("score") > t))
    per = (s.withColumn("b", b).where(F.col("b") > 0)
           .groupBy(*g, "code", "b").agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("pos")))
    # bucket b counts as predicted for grid indexes 0 .. b-1
    per_k = (per.select(*g, "code", "n", "pos", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k"))
             .groupBy(*g, "code", "k").agg(F.sum("n").alias("n_pred"), F.sum("pos").alias("tp")))
    sup = _support(truth, tg)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_pred") + F.col("support"))).otherwise(0.0)
    cand = per_k.join(sup, [*tg, "code"]).where(F.col("support") >= min_support)
    best = cand.groupBy(*g, "code").agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("nk"))).alias("b"))
    picked = best.select(*g, "code", F.when(F.col("b.f1") > 0, garr[-F.col("b.nk")]).alias("t"),
                         F.col("b.f1").alias("f1"))
    base = codes if codes is not None else scores.select(*g, "code").distinct()
    return (base.join(picked, [*g, "code"], "left")
            .select(*g, "code", F.coalesce("t", F.lit(float(default))).alias("threshold")))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, groups: Sequence[str] = (),
                     inclusive: bool = True) -> DataFrame:
    """O-A6: predicted = score >= t (inclusive) or score > t; NULL t = never.

    The threshold table has one row per (groups, code).
    """
    g = list(groups)
    t = thresholds.select(*g, "code", "threshold")
    j = scores.join(t, [*g, "code"], "left")
    cmp = (F.col("score") >= F.col("threshold")) if inclusive else (F.col("score") > F.col("threshold"))
    return j.withColumn("predicted", F.coalesce(cmp, F.lit(False))).drop("threshold")


def cv_predict(scores: DataFrame, truth: DataFrame, folds: DataFrame, n_folds: int = 5,
               groups: Sequence[str] = ()) -> DataFrame:
    """O-A7: out-of-fold predictions in one job.

    Scores and truth are joined and counted once by (fold, code, score); these
    counts, not the rows, are spread over the tuning sets of the other folds.
    Thresholds are picked per (tuning set, code) and applied to the rows of that
    fold.  Returns scores with ``predicted``.
    """
    g = list(groups)
    tg = [c for c in g if c in truth.columns]
    f = folds.select("doc_id", "fold")
    all_f = F.array(*[F.lit(i) for i in range(n_folds)])
    s = scores.join(f, "doc_id")

    def spread(df, keys, values):
        others = F.explode(F.array_except(all_f, F.array(F.col("fold"))))
        return (df.withColumn("tune_fold", others).groupBy(*keys, "tune_fold").agg(*[F.sum(v).alias(v) for v in values])
                .withColumnRenamed("tune_fold", "fold"))

    per = spread(_score_counts(s, truth, [*g, "fold"], tg), [*g, "code", "score"], ["n", "pos"])
    support = spread(_support(truth.join(f, "doc_id"), [*tg, "fold"]), [*tg, "code"], ["support"])
    th = _pick(per, support, [*g, "fold"], [*tg, "fold"])
    return apply_thresholds(s, th, [*g, "fold"], inclusive=True)


def cv_predict_nested(hits: DataFrame, truth: DataFrame, folds: DataFrame, n_folds: int = 5, digits: int = 9) -> DataFrame:
    """O-A7 nested: out-of-fold predictions whose pattern weights don't know the
    test fold either.

    ``hits`` (doc_id, pattern_id, code).  Hits are counted once by (pattern,
    fold); the weights without a fold are the totals less that fold's counts, so
    nothing is fitted again.  Scores under the weights without fold f tune the
    thresholds on the other folds and are compared with them in fold f.
    Returns (doc_id, code, score, fold, predicted) of the positive scores.
    """
    f = folds.select("doc_id", "fold")
    y = truth.select("doc_id", "code", F.lit(1).alias("_y"))
    h = hits.select("doc_id", "pattern_id", "code").join(f, "doc_id").join(y, ["doc_id", "code"], "left")
    per = h.groupBy("pattern_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("pos"))
    total = per.groupBy("pattern_id").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                          F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "pos")))).alias("by"))   # n_folds entries
    without = total.select("pattern_id", "n", "pos", "by", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("out_fold"))
    own = F.try_element_at("by", F.col("out_fold"))
    n, pos = F.col("n") - F.coalesce(own["n"], F.lit(0)), F.col("pos") - F.coalesce(own["pos"], F.lit(0))
    w = without.select("pattern_id", "out_fold", (pos / F.greatest(n, F.lit(1))).alias("weight"))
    scores = (h.select("doc_id", "fold", "pattern_id", "code", F.col("_y").isNotNull().alias("y")).join(w, "pattern_id")
              .groupBy("out_fold", "fold", "doc_id", "code").agg(F.round(F.sum("weight"), digits).alias("score"), F.max("y").alias("y"))
              .where("score > 0"))
    counts = (scores.where("fold <> out_fold").groupBy("out_fold", "code", "score")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos")))
    others = F.explode(F.array_except(F.array(*[F.lit(i) for i in range(n_folds)]), F.array(F.col("fold"))))
    support = (truth.join(f, "doc_id").groupBy("fold", "code").agg(F.count(F.lit(1)).alias("support"))
               .withColumn("out_fold", others).groupBy("out_fold", "code").agg(F.sum("support").alias("support")))
    th = _pick(counts, support, ["out_fold"], ["out_fold"])
    own_fold = scores.where("fold = out_fold")
    return apply_thresholds(own_fold, th, ["out_fold"], inclusive=True).select("doc_id", "code", "score", "fold", "predicted")
