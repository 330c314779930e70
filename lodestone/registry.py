"""Names of the engine's queries, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.catalog import aggregates, chunking, relational, retrieval, scoring, sources, streams, text, windows  # noqa: F401  they register
from lodestone.catalog.base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for a batch of questions."""
    return QUERIES["hybrid_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
