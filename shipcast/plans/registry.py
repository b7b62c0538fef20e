"""Query registry: ID -> Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express the operator, ID -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from shipcast.plans import (  # noqa: F401
        q_core,
        q_eda,
        q_decision,
        q_quality,
        q_stats,
        q_metrics,
        q_leakage,
        q_reports,
        q_ml,
    )
