"""Precision-weighted scoring and the hybrid's post-processors.

hits     (doc_id, pattern_id, code)  one row per (document, pattern)
weights  (pattern_id, code, hits, hits_pos, weight)
scores   (doc_id, code, score)       sparse: zero scores are not stored
preds    (doc_id, code, score, predicted)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9   # sums of weights are rounded so equal sets of weights tie exactly


def pattern_precision(hits: DataFrame, truth: DataFrame, patterns: DataFrame) -> DataFrame:
    """O-A1: per pattern: documents hit, hits on documents of its code,
    weight = hits_pos / max(hits, 1).  Patterns without hits get weight 0."""
    y = truth.select("doc_id", "code", F.lit(1).alias("_y"))
    per = (hits.select("doc_id", "pattern_id", "code").join(y, ["doc_id", "code"], "left")
           .groupBy("pattern_id").agg(F.count(F.lit(1)).alias("hits"), F.count("_y").alias("hits_pos")))
    return (patterns.select("pattern_id", "code").join(per, "pattern_id", "left")
            .select("pattern_id", "code", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
                    F.coalesce("hits_pos", F.lit(0)).cast("bigint").alias("hits_pos"),
                    (F.coalesce("hits_pos", F.lit(0)) / F.greatest(F.coalesce("hits", F.lit(0)), F.lit(1)))
                    .alias("weight")))


def doc_code_score(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """O-A2/O-A3: score(doc, code) = sum of the weights of matched patterns.

    ``weights`` is the (frozen) per-pattern table; unseen documents reuse it
    without labels.
    Zero scores are dropped (sparse).
    """
    w = weights.select("pattern_id", "weight")
    return (hits.select("doc_id", "pattern_id", "code").join(w, "pattern_id")
            .groupBy("doc_id", "code").agg(F.round(F.sum("weight"), SCORE_DIGITS).alias("score"))
            .where(F.col("score") > 0))


def unit_scores(scores: DataFrame, norm: DataFrame | float | None = None) -> DataFrame:
    """O-A9: score / norm clipped to [0, 1]; norm = max(max score, 1) unless given.

    A given ``norm`` keeps the scale of an earlier batch.
    """
    if norm is None:
        n = scores.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("_norm"))
    elif isinstance(norm, DataFrame):
        n = norm.select(F.col(norm.columns[0]).alias("_norm"))
    else:
        n = scores.sparkSession.range(1).select(F.lit(float(norm)).alias("_norm"))
    return (scores.crossJoin(F.broadcast(n))  # one row
            .withColumn("score", F.least(F.greatest(F.col("score") / F.col("_norm"), F.lit(0.0)), F.lit(1.0)))
            .drop("_norm"))


def tail_bucket(docs: DataFrame, truth: DataFrame, head_codes: DataFrame) -> DataFrame:
    """O-M8: documents carrying no head code (by truth)."""
    with_head = truth.join(F.broadcast(head_codes.select("code")), "code", "left_semi").select("doc_id")
    return docs.join(with_head, "doc_id", "left_anti")


def tail_routed(docs: DataFrame, preds: DataFrame, head_codes: DataFrame) -> DataFrame:
    """O-M9: documents for which the first variant predicts no head code."""
    fired = (preds.where(F.col("predicted"))
             .join(F.broadcast(head_codes.select("code")), "code", "left_semi").select("doc_id"))
    return docs.join(fired, "doc_id", "left_anti")


def champion(f1_a: DataFrame, f1_b: DataFrame, codes: DataFrame) -> DataFrame:
    """O-H1: per code variant 1 when F1(v1) >= F1(v2) (missing F1 = 0), else 2."""
    a = f1_a.select("code", F.col("f1").alias("f1_v1"))
    b = f1_b.select("code", F.col("f1").alias("f1_v2"))
    j = codes.select("code").join(a, "code", "left").join(b, "code", "left")
    return j.select("code", F.coalesce("f1_v1", F.lit(0.0)).alias("f1_v1"),
                    F.coalesce("f1_v2", F.lit(0.0)).alias("f1_v2"),
                    F.when(F.coalesce("f1_v1", F.lit(0.0)) >= F.coalesce("f1_v2", F.lit(0.0)), 1)
                    .otherwise(2).alias("champion"))


def blend(v1: DataFrame, v2: DataFrame, champ: DataFrame) -> DataFrame:
    """O-H2: per code take score and prediction from the champion variant."""
    u = (v1.select("doc_id", "code", "score", "predicted", F.lit(1).alias("variant"))
         .unionByName(v2.select("doc_id", "code", "score", "predicted", F.lit(2).alias("variant"))))
    ch = F.broadcast(champ.select("code", F.col("champion").alias("variant")))
    return u.join(ch, ["code", "variant"], "left_semi").drop("variant")


def tiebreak(preds: DataFrame, texts: DataFrame, group: Sequence[int],
             rules: Sequence[tuple[str, int]], default: int, space: DataFrame | None = None) -> DataFrame:
    """O-H3: if any code of ``group`` is predicted for a document, exactly one
    stays set: the first rule whose regex (case-insensitive, dot-all) finds
    the raw text wins, else ``default``.  A rule or default whose code is not in
    the label space is passed over; without any winner the predictions stay.  The
    winner may be a code that did not fire.  Needs at least two group codes in the label space.

    ``preds`` (doc_id, code, score, predicted) sparse; ``texts`` (doc_id, text).
    The rule regexes run in one narrow pass over the texts; only the small
    (doc_id, winner) result is joined to the fired documents, so no text is
    shuffled.
    """
    grp = [int(c) for c in group]
    preds = preds.select("doc_id", "code", "score", "predicted")
    fired = (preds.where(F.col("predicted") & F.col("code").isin(*grp)).select("doc_id").distinct())
    # one array of the group's codes that are in the space; a rule whose code is not falls through
    rule_rx = [(F.col("text").rlike(f"(?isu){rx}"), int(code)) for rx, code in rules]
    matched = F.filter(F.array(*[F.when(hit, F.lit(code)) for hit, code in rule_rx], F.lit(int(default))), lambda c: c.isNotNull())
    # union + aggregate (not a join) so the optimiser cannot move the text into the shuffle
    cand = texts.select("doc_id", matched.alias("matched"), F.lit(0).alias("_f"))
    win = (cand.unionByName(fired.select("doc_id", F.lit(None).cast("array<int>").alias("matched"), F.lit(1).alias("_f")))
           .groupBy("doc_id").agg(F.max("matched").alias("matched"), F.max("_f").alias("_f"))
           .where(F.col("_f") == 1).drop("_f"))
    if space is not None:   # one row of at most len(group) codes
        present = space.where(F.col("code").isin(*grp)).agg(F.collect_set(F.col("code").cast("int")).alias("_k"))
        win = (win.crossJoin(F.broadcast(present)).where(F.size("_k") >= 2)
               .withColumn("matched", F.filter("matched", lambda c: F.array_contains("_k", c))).drop("_k"))
    win = win.select("doc_id", F.get("matched", F.lit(0)).alias("winner")).where("winner IS NOT NULL")
    p = preds.join(win, "doc_id", "left")
    in_group = F.col("code").isin(*grp)
    kept = p.withColumn("predicted", F.when(F.col("winner").isNotNull() & in_group,
                                            F.col("code") == F.col("winner")).otherwise(F.col("predicted")))
    # the winner may have no stored row: add it with score 0
    have = p.where(F.col("winner").isNotNull() & (F.col("code") == F.col("winner"))).select("doc_id")
    added = (win.join(have, "doc_id", "left_anti")
             .select("doc_id", F.col("winner").alias("code"), F.lit(0.0).alias("score"),
                     F.lit(True).alias("predicted")))
    return kept.drop("winner").unionByName(added)


def _without(codes, loser):
    return F.map_filter(codes, lambda k, v: k != loser)


def mutex(preds: DataFrame, ref_scores: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """O-H4: for each pair (a, b), in order: when both are predicted keep the one
    with the higher reference score (a on ties) and clear the other.

    One pass: the set pair codes of a document go into a small map, the pairs
    are folded over it in order, and the codes that lost are joined back once.
    """
    codes = sorted({int(c) for p in pairs for c in p})
    if not codes:
        return preds
    ref = ref_scores.select("doc_id", "code", F.col("score").alias("_ref"))
    side = (preds.where(F.col("predicted") & F.col("code").isin(*codes)).select("doc_id", "code").distinct()
            .join(ref.where(F.col("code").isin(*codes)), ["doc_id", "code"], "left").groupBy("doc_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("code", F.coalesce("_ref", F.lit(0.0))))).alias("_m")))
    left = F.col("_m")   # the codes that are still set, folded over the pairs in order
    for i, (a, b) in enumerate(pairs):
        name = f"_m{i}"
        a, b = F.lit(int(a)), F.lit(int(b))
        loser = F.when(F.try_element_at(left, a) >= F.try_element_at(left, b), b).otherwise(a)
        both = F.map_contains_key(left, a) & F.map_contains_key(left, b)
        side = side.withColumn(name, F.when(both, _without(left, loser)).otherwise(left))
        left = F.col(name)
    lost = side.select("doc_id", F.array_except(F.map_keys("_m"), F.map_keys(left)).alias("_lost")).where(F.size("_lost") > 0)
    out = preds.join(lost, "doc_id", "left")
    return out.withColumn("predicted", F.when(F.coalesce(F.array_contains("_lost", F.col("code")), F.lit(False)), F.lit(False))
                          .otherwise(F.col("predicted"))).drop("_lost")
