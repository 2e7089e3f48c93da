"""Calibration: pooled cells, reliability curve, temperature scaling.

cells (method, doc_id, code, score, y) -- every (document, code) of the
evaluated documents for each method (dense), y = 1 for a true code.
The temperature grid is fused into one pass: each cell is replicated once
per temperature, partially aggregated per (method, T, bin) map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_FLOOR = 0.05
N_BINS = 10
EPS = 1e-7


def temperature_grid(start: float = 0.3, stop: float = 5.01, step: float = 0.1) -> list[float]:
    vals, k = [], 0
    while start + k * step < stop:
        vals.append(start + k * step)
        k += 1
    return vals


def bin_edges(n_bins: int = N_BINS) -> list[float]:
    """Inner edges of ``n_bins`` uniform bins over [0, 1 + 1e-8]."""
    step = (1.0 + 1e-8) / n_bins
    return [k * step for k in range(1, n_bins)]


def logit(p: Column, eps: float = EPS) -> Column:
    """O-C3: ln(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bin_of(p: Column, n_bins: int = N_BINS) -> Column:
    """Right-closed uniform bin: number of inner edges strictly below p."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    return F.size(F.filter(edges, lambda e: e < p))


def pool(cells: DataFrame, floor: float | None = SCORE_FLOOR) -> DataFrame:
    """O-C1/O-P7: per method: cells and positive rate before and after the floor."""
    return cells.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("y").alias("pos_rate"),
        F.sum(F.when(F.col("score") >= floor, 1).otherwise(0)).cast("bigint").alias("n_kept"),
        F.avg(F.when(F.col("score") >= floor, F.col("y"))).alias("pos_rate_kept"))


def reliability(cells: DataFrame, n_bins: int = N_BINS, floor: float | None = SCORE_FLOOR) -> DataFrame:
    """O-C2: per (method, bin) mean score and positive fraction, non-empty bins."""
    c = cells.where(F.col("score") >= floor) if floor is not None else cells
    return (c.withColumn("bin", bin_of(F.col("score"), n_bins)).groupBy("method", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_pred"), F.avg("y").alias("frac_pos")))


def mace_by_temperature(cells: DataFrame, temps: Sequence[float] | None = None, n_bins: int = N_BINS,
                        floor: float | None = SCORE_FLOOR) -> DataFrame:
    """O-C4: MACE (unweighted mean |mean_pred - frac_pos| over non-empty bins)
    for every temperature, all in one aggregation."""
    temps = list(temps or temperature_grid())
    c = cells.where(F.col("score") >= floor) if floor is not None else cells
    tarr = F.array(*[F.lit(float(t)) for t in temps])
    x = c.select("method", "y", logit(F.col("score")).alias("z"), F.posexplode(tarr).alias("t_idx", "T"))
    p = sigmoid(F.col("z") / F.col("T"))
    per_bin = (x.withColumn("p", p).withColumn("bin", bin_of(F.col("p"), n_bins))
               .groupBy("method", "t_idx", "T", "bin").agg(F.avg("p").alias("mp"), F.avg("y").alias("fp")))
    return per_bin.groupBy("method", "t_idx", "T").agg(F.avg(F.abs(F.col("mp") - F.col("fp"))).alias("mace"))


def fit_temperature(cells: DataFrame, temps: Sequence[float] | None = None, n_bins: int = N_BINS,
                    floor: float | None = SCORE_FLOOR) -> DataFrame:
    """O-C5: per method the temperature with the lowest MACE (first on ties)."""
    m = mace_by_temperature(cells, temps, n_bins, floor)
    best = m.groupBy("method").agg(F.min(F.struct("mace", "t_idx", "T")).alias("b"))
    return best.select("method", F.col("b.T").alias("temperature"), F.col("b.mace").alias("mace"))


def calibrate(preds: DataFrame, temps: DataFrame, thresholds: DataFrame | None = None,
              default_threshold: float = 0.5, suffix: str = "_cal",
              rescale_thresholds: bool = False) -> DataFrame:
    """O-C6: calibrated scores sigmoid(logit(p) / T); predicted with strict
    ``>`` against the per-code thresholds (tuned on raw scores, as fitted);
    written as a new method ``{method}{suffix}`` (never over its input).

    With ``rescale_thresholds`` each threshold goes through the same
    monotone map, so decisions stay those of the raw scores."""
    j = preds.join(F.broadcast(temps.select("method", "temperature")), "method")
    j = j.withColumn("score", sigmoid(logit(F.col("score")) / F.col("temperature")))
    if thresholds is not None:
        t = F.broadcast(thresholds.select("method", "code", "threshold"))
        j = j.join(t, ["method", "code"], "left").withColumn(
            "threshold", F.coalesce("threshold", F.lit(float(default_threshold))))
    else:
        j = j.withColumn("threshold", F.lit(float(default_threshold)))
    if rescale_thresholds:
        j = j.withColumn("threshold", sigmoid(logit(F.col("threshold")) / F.col("temperature")))
    return j.select(F.concat(F.col("method"), F.lit(suffix)).alias("method"), "doc_id", "code", "score",
                    (F.col("score") > F.col("threshold")).alias("predicted"))
