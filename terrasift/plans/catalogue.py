"""The registered queries and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detect, feature_queries, record_queries, shape_queries, source_queries, terrain_queries

MODULES = (terrain_queries, feature_queries, source_queries, shape_queries, record_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface to ranked candidates."""
    return detect.detect_candidates(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"detect_candidates": detect.detect_candidates} | {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
