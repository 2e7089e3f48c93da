"""Label space, multi-hot encoding, supports and frozen stratified splits.

Truth is kept sparse and long: ``truth(doc_id, code)``, a row present = 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.ranking import exact_row_number, hash_bucket

SEED = 42          # frozen-split seed
VAL_SHARE = 0.10   # validation share of each stratum
N_FOLDS = 5


def truth_from_codes(deeds: DataFrame, codes_col: str = "codes") -> DataFrame:
    """Explode a documents table with ``codes ARRAY<INT>`` to distinct (doc_id, code)."""
    return (deeds.select("doc_id", F.explode(codes_col).alias("code"))
            .where(F.col("code").isNotNull()).distinct())


def label_space(truth: DataFrame) -> DataFrame:
    """O-L1: ordered label space (code, idx) of all codes seen in ``truth``.

    The label space is small by definition (one row per code), so the global
    ordering window runs over a bounded table.
    """
    codes = truth.select("code").distinct()
    return codes.select("code", (F.row_number().over(Window.orderBy("code")) - 1)
                        .cast("int").alias("idx"))


def restrict_to_space(truth: DataFrame, space: DataFrame) -> DataFrame:
    """O-L2/O-L3: keep only codes of the label space (others are ignored)."""
    return truth.join(F.broadcast(space.select("code")), "code", "left_semi")


def multi_hot(truth: DataFrame, space: DataFrame, docs: DataFrame) -> DataFrame:
    """O-L2 dense form: one row per document, ``y ARRAY<INT>`` in label-space order."""
    per_doc = (restrict_to_space(truth, space).groupBy("doc_id")
               .agg(F.collect_set("code").alias("codes")))
    classes = space.agg(F.array_sort(F.collect_list("code")).alias("classes"))
    return (docs.select("doc_id").join(per_doc, "doc_id", "left")
            .crossJoin(F.broadcast(classes))   # one-row table: no fan-out
            .select("doc_id", F.transform("classes", lambda c: F.when(
                F.coalesce(F.array_contains("codes", c), F.lit(False)), 1).otherwise(0)).alias("y")))


def support(truth: DataFrame) -> DataFrame:
    """O-A11: documents per code."""
    return truth.groupBy("code").agg(F.countDistinct("doc_id").alias("support"))


def head_tail(truth: DataFrame, cutoff: int | None = None, share: float | None = None,
              n_docs: DataFrame | None = None) -> DataFrame:
    """O-P9: (code, support, is_head) with head = support >= cutoff.

    ``cutoff`` is absolute; with ``share`` the cutoff is ``share * N`` where N
    is the number of documents in ``n_docs`` (a one-row frame with column n).
    """
    s = support(truth)
    if cutoff is not None:
        return s.withColumn("is_head", F.col("support") >= F.lit(cutoff))
    n = n_docs if n_docs is not None else truth.agg(F.countDistinct("doc_id").alias("n"))
    return (s.crossJoin(F.broadcast(n.select("n")))
            .withColumn("is_head", F.col("support") >= F.col("n") * F.lit(share)).drop("n"))


def stratum(truth: DataFrame) -> DataFrame:
    """Rarest code of each document (ties: lowest code): (doc_id, stratum)."""
    sup = truth.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return (truth.join(F.broadcast(sup), "code")
            .groupBy("doc_id").agg(F.min(F.struct("n", "code")).alias("m"))
            .select("doc_id", F.col("m.code").alias("stratum")))


def stratified_split(truth: DataFrame, docs: DataFrame | None = None, seed: int = SEED,
                     val_share: float = VAL_SHARE, n_folds: int = N_FOLDS) -> DataFrame:
    """O-L5/O-L7: deterministic stratified split and CV folds.

    stratum = rarest code; rank inside the stratum by md5(seed|doc_id), then
    doc_id; the first ``round(n * val_share)`` ranks are val; fold =
    (rank-1) % n_folds.  Documents without codes (when ``docs`` is given) form
    stratum -1.  Ranks are exact and computed in two levels, so a stratum
    holding a third of all documents is spread over many tasks.
    """
    st = stratum(truth)
    if docs is not None:
        st = (docs.select("doc_id").join(st, "doc_id", "left")
              .select("doc_id", F.coalesce("stratum", F.lit(-1)).alias("stratum")))
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))
    st = st.withColumn("_h", h)
    ranked = exact_row_number(st, ["stratum"], hash_bucket(F.col("_h")), ["_h", "doc_id"],
                              out="rn", size_col="n")
    return ranked.select(
        "doc_id", "stratum", "rn",
        ((F.col("rn") - 1) % n_folds).cast("int").alias("fold"),
        F.when(F.col("rn") <= F.floor(F.col("n") * F.lit(val_share) + F.lit(0.5)), "val")
        .otherwise("train").alias("split"))


def apply_split(df: DataFrame, splits: DataFrame, which: str) -> DataFrame:
    """O-L6: rows of ``df`` whose document is in split ``which``."""
    ids = splits.where(F.col("split") == which).select("doc_id")
    return df.join(ids, "doc_id", "left_semi")


def split_stats(truth: DataFrame, splits: DataFrame, space: DataFrame) -> DataFrame:
    """O-L4/O-P10: per split: documents, multi-label share, codes with zero support."""
    per_doc = truth.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    d = splits.select("doc_id", "split").join(per_doc, "doc_id", "left")
    stats = d.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("bigint").alias("n_multi"))
    seen = (truth.join(splits.select("doc_id", "split"), "doc_id")
            .groupBy("split").agg(F.countDistinct("code").alias("n_codes_seen")))
    n_space = space.agg(F.count(F.lit(1)).alias("n_space"))
    return (stats.join(seen, "split", "left").crossJoin(F.broadcast(n_space))
            .select("split", "n_docs", "n_multi",
                    F.round(F.col("n_multi") / F.col("n_docs"), 6).alias("multi_share"),
                    (F.col("n_space") - F.coalesce("n_codes_seen", F.lit(0))).cast("bigint")
                    .alias("zero_support_codes")))
