"""The pattern table: phrases from curated and mined sources with ids.

Columns: code, pattern_id, source, source_text, regex, name, match_zone,
fuzzy_gap, is_regex.  Duplicate phrases are kept (each is its own pattern and its
weight adds up); only (document, pattern) hits are de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions import text as tx


def with_ids(rows: DataFrame, order_col: str = "ord") -> DataFrame:
    """O-N10: pattern_id = '{code}-{source}-{seq:03d}', seq per (code, source)
    in input order (``order_col``).  One window partition per (code, source):
    bounded by the phrases of one source for one code."""
    w = Window.partitionBy("code", "source").orderBy(order_col)
    return rows.withColumn("pattern_id", F.format_string(
        "%d-%s-%03d", F.col("code"), F.col("source"), F.row_number().over(w)))


def from_phrases(rows: DataFrame, order_col: str = "ord") -> DataFrame:
    """Curated rows (code, source, phrase, match_zone[, fuzzy_gap][, name][, regex], ord)
    -> pattern rows; a row with a ``regex`` of its own keeps it (``is_regex``), for
    the others it is made from the phrase; empty ones are dropped (O-P5)."""
    gap = F.coalesce(F.col("fuzzy_gap"), F.lit(True)) if "fuzzy_gap" in rows.columns else F.lit(True)
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    own = F.col("regex") if "regex" in rows.columns else F.lit(None).cast("string")
    r = rows.select("code", "source", F.coalesce("phrase", own).alias("source_text"),
                    F.coalesce(own, tx.phrase_regex(F.col("phrase"), gap)).alias("regex"), name.alias("name"),
                    F.coalesce(F.col("match_zone"), F.lit("full")).alias("match_zone"),
                    gap.alias("fuzzy_gap"), own.isNotNull().alias("is_regex"), F.col(order_col))
    return with_ids(r.where(F.col("regex") != ""), order_col)
