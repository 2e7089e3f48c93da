"""Registry of named queries: each key maps to a Spark builder
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, the oracle SQL
an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its keys are registered."""
    from labelflow.plans import (  # noqa: F401
        q_labels_metrics, q_sources, q_text_matching, q_thresholds, q_mining,
        q_hybrid, q_orchestration, q_calibration, q_learn, flagship)
