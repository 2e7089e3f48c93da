"""Exact ranks and running sums inside groups of any size.

A plain ``row_number() over (partition by g order by k)`` puts a whole group
into one task.  When one group may hold a third of all rows we rank in two
levels instead:

1. a monotone *bucket* of the order key splits the group into many slices;
2. per (group, bucket) counts/totals (a small table) get their offsets from a
   window over buckets only;
3. a window inside (group, bucket) adds the offset back.

The result is identical to the single window as long as ordering by
``(bucket, order keys)`` equals ordering by the order keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def exact_row_number(df: DataFrame, group_cols: Sequence[str], bucket: Column,
                     order_cols: Sequence[Column | str], out: str = "rn",
                     size_col: str | None = None) -> DataFrame:
    """Add ``out`` = row_number() within ``group_cols`` ordered by ``order_cols``.

    ``bucket`` must be monotone non-decreasing in the order.  If ``size_col``
    is given, the group size is added as well.
    """
    g = list(group_cols)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*g, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wprev = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wprev), F.lit(0)))
    if size_col:
        offs = offs.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*g)))
    offs = offs.drop("_cnt")
    w = Window.partitionBy(*g, "_bkt").orderBy(*_cols(order_cols))
    return (b.join(offs, on=[*g, "_bkt"], how="inner")
            .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("int"))
            .drop("_bkt", "_off"))


def running_totals_desc(df: DataFrame, group_cols: Sequence[str], order_col: str,
                        value_cols: Sequence[str], bucket: Column,
                        suffix: str = "_cum") -> DataFrame:
    """Cumulative sums of ``value_cols`` from the highest ``order_col`` down.

    ``df`` must hold at most one row per (group, order value); ``bucket`` must
    be monotone non-decreasing in ``order_col``.  Row ``r`` gets the sum over
    all rows of its group with ``order_col >= r.order_col``.
    """
    g = list(group_cols)
    b = df.withColumn("_bkt", bucket)
    tots = b.groupBy(*g, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # buckets above this one (higher order values) come first in a desc order
    wabove = Window.partitionBy(*g).orderBy(F.col("_bkt").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    offs = tots.select(*g, "_bkt", *[
        F.coalesce(F.sum(f"_t_{v}").over(wabove), F.lit(0)).alias(f"_o_{v}")
        for v in value_cols])
    w = (Window.partitionBy(*g, "_bkt").orderBy(F.col(order_col).desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    out = b.join(offs, on=[*g, "_bkt"], how="inner")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.sum(v).over(w))
    return out.drop("_bkt", *[f"_o_{v}" for v in value_cols])


def score_bucket(col: str | Column, per_octave: int = 64) -> Column:
    """Monotone bucket for positive scores: log2 scale, ``per_octave`` slices."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > 0, F.floor(F.log2(c) * per_octave)).otherwise(F.lit(-(1 << 30))).cast("long")


def hash_bucket(hex_col: Column, digits: int = 4) -> Column:
    """Monotone bucket of a hex digest: its first ``digits`` characters."""
    return F.substring(hex_col, 1, digits)
