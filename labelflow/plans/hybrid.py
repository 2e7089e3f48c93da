"""The two-variant phrase classifier, end to end (fit on train, predict new
documents), composed from the operators.

V1: patterns for all codes mined on the train documents.
V2: patterns for tail codes mined on the tail bucket (train documents with
    no head code); at prediction time a document goes to V2 when V1
    predicts no head code for it.
Champion per code by cross-validated F1 on train; the tie-break group runs
inside each variant, mutex pairs on the blended predictions (by V1 score);
scores are put on one [0, 1] scale with a norm shared by all predicted sets.

Both variants' patterns are matched in one pass over a set of documents, into
one hit table keyed by variant.  What several steps read (hits, weights,
thresholds, cross-validated and final predictions) is materialised, so each
plan starts from a scan and nothing is fitted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.operators import labels, matching, metrics, scoring, thresholds
from labelflow.session import materialize


@dataclass
class HybridConfig:
    prefix_rx: str | None
    window: int = 500
    title_len: int = 600
    head_share: float = 0.3
    tiebreak_group: Sequence[int] = ()
    tiebreak_rules: Sequence[tuple[str, int]] = ()
    tiebreak_default: int | None = None
    mutex_pairs: Sequence[tuple[int, int]] = ()
    n_folds: int = 5


@dataclass
class Variant:
    patterns: DataFrame
    weights: DataFrame
    thresholds: DataFrame
    codes: DataFrame


def _hits(docs: DataFrame, patterns: dict[int, DataFrame], cfg: HybridConfig) -> DataFrame:
    """(variant, doc_id, pattern_id, code): one pass for the patterns of all variants."""
    both = None
    for v, p in patterns.items():
        p = p.withColumn("pattern_id", F.concat(F.lit(f"{v}|"), "pattern_id"))
        both = p if both is None else both.unionByName(p)
    hits = matching.match_patterns(docs, both, cfg.prefix_rx, cfg.window, cfg.title_len)
    return materialize(hits.select(F.substring("pattern_id", 1, 1).cast("int").alias("variant"), "doc_id",
                                   F.expr("substr(pattern_id, 3)").alias("pattern_id"), "code"))


def _fit(patterns: DataFrame, hits: DataFrame, docs: DataFrame, truth: DataFrame, codes: DataFrame, folds: DataFrame,
         cfg: HybridConfig) -> tuple[Variant, DataFrame]:
    """Precision weights, in-sample thresholds and cross-validated predictions of
    one variant, from its hits on ``docs``; ``truth`` within them and ``codes``."""
    w = materialize(scoring.pattern_precision(hits, truth, patterns))
    s = materialize(scoring.doc_code_score(hits, w))
    th = materialize(thresholds.tune_exact(s, truth))
    cv = materialize(thresholds.cv_predict(s, truth, folds.join(docs.select("doc_id"), "doc_id", "left_semi"), cfg.n_folds))
    return Variant(patterns, w, th, codes), materialize(_tiebreak(cv, docs, codes, cfg))


def _predict(v: Variant, hits: DataFrame, docs: DataFrame, cfg: HybridConfig) -> DataFrame:
    p = materialize(thresholds.apply_thresholds(scoring.doc_code_score(hits, v.weights), v.thresholds, inclusive=True))
    return materialize(_tiebreak(p, docs, v.codes, cfg))


def _tiebreak(p: DataFrame, docs: DataFrame, codes: DataFrame, cfg: HybridConfig) -> DataFrame:
    if not cfg.tiebreak_group:
        return p
    return scoring.tiebreak(p, docs, cfg.tiebreak_group, cfg.tiebreak_rules, cfg.tiebreak_default, codes)


def run_hybrid(train: DataFrame, eval_docs: DataFrame, truth: DataFrame, space: DataFrame,
               folds: DataFrame, build_patterns: Callable[[DataFrame, DataFrame], DataFrame],
               cfg: HybridConfig) -> dict[str, DataFrame]:
    """O-H5: fit on ``train`` (doc_id, text; prefix already stripped), predict
    ``eval_docs``; returns champion table, head codes, the shared norm, the
    fitted tables of both variants and the eval predictions (doc_id, code, score
    in [0, 1], predicted)."""
    train, truth, space = materialize(train), materialize(truth), materialize(space)
    ht = labels.head_tail(labels.restrict_to_space(truth.join(train, "doc_id", "left_semi"), space),
                          share=cfg.head_share, n_docs=train.agg(F.count(F.lit(1)).alias("n")))
    ht = materialize(space.select("code").join(ht, "code", "left").fillna({"is_head": False}))
    head = ht.where(F.col("is_head")).select("code")
    tail = ht.where(~F.col("is_head")).select("code")
    bucket = materialize(scoring.tail_bucket(train, truth, head))
    t1 = materialize(labels.restrict_to_space(truth.join(train.select("doc_id"), "doc_id", "left_semi"), space))
    t2 = materialize(labels.restrict_to_space(t1.join(bucket.select("doc_id"), "doc_id", "left_semi"), tail))

    # pattern_id, code and what the matcher reads
    pats = {1: materialize(build_patterns(space.select("code"), train)), 2: materialize(build_patterns(tail, bucket))}
    hits = _hits(train, pats, cfg)
    of = lambda h, v, docs: h.where(F.col("variant") == v).join(docs.select("doc_id"), "doc_id", "left_semi")
    v1, cv1 = _fit(pats[1], of(hits, 1, train), train, t1, space.select("code"), folds, cfg)
    v2, cv2 = _fit(pats[2], of(hits, 2, bucket), bucket, t2, tail, folds, cfg)
    cv = cv1.withColumn("method", F.lit("v1")).unionByName(cv2.withColumn("method", F.lit("v2")))
    pc = materialize(metrics.per_class(cv, t1, train.select("doc_id"), space, digits=None, methods=["v1", "v2"]))
    champ = materialize(scoring.champion(pc.where("method = 'v1'"), pc.where("method = 'v2'"), space))

    hits = _hits(eval_docs, pats, cfg)
    p1 = _predict(v1, of(hits, 1, eval_docs), eval_docs, cfg)
    routed_docs = scoring.tail_routed(eval_docs, p1, head)
    p2 = _predict(v2, of(hits, 2, routed_docs), routed_docs, cfg)
    blended = scoring.blend(p1, p2, champ)
    if cfg.mutex_pairs:
        blended = scoring.mutex(blended, p1.select("doc_id", "code", "score"), cfg.mutex_pairs)
    blended = materialize(blended)
    # the scale all predicted sets share; a later batch passes it to unit_scores
    norm = materialize(blended.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("norm")))
    fitted = {f"{name}_{part}": getattr(v, part) for name, v in (("v1", v1), ("v2", v2))
              for part in ("patterns", "weights", "thresholds")}
    return {"champion": champ, "head_tail": ht, "norm": norm, "pred": scoring.unit_scores(blended, norm), **fitted}
