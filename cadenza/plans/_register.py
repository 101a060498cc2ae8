"""Where the library's queries are registered, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The series of the events table: one for each user, frames in order of time.
SERIES = """s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, value AS v, event_type AS grp FROM events)"""
#: The channels of the embeddings table in long form; rows of a label are frames of one series.
VECTORS = """e AS (SELECT label AS series_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, vec_id, embedding FROM embeddings),
x AS (SELECT series_id, t, vec_id, unnest(range(64)) AS ch, unnest(embedding)::DOUBLE AS v FROM e)"""
#: A hash that both engines compute alike.
LCG = "((({id}) * 1103515245 + {seed} * 12345) % 2147483648)"


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)
