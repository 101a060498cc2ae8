"""All registered queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans import aggregates, dependence, distance, layout, matching, pictures, recurrence, relational, scalar, stream, structure, windows  # noqa: F401  the modules register their queries
from cadenza.plans._register import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependence of each series' activity on its energy, by group."""
    return QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(ORACLES)
