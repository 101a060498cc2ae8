"""Places of rows in an order within their groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._common import broadcast_if_small, free, stage


def numbered(rows: DataFrame, group: str, order: list[str], name: str, place: str = "pos", size: str = "n") -> DataFrame:
    """rows with their place (from 0) among those of their group (never null) in the order, and the group's size.

    Rows are cut into sorted ranges over all groups and written; the counts of each range and group, a table of as many rows as
    there are ranges and groups, give what stands before it. A group of any size is so spread over ranges.
    """
    at, part, first, before = (free(x, rows) for x in ("_at", "_part", "_first", "_before"))
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    held = stage(ranged.withColumn(at, F.monotonically_increasing_id()), name)
    held = held.withColumn(part, F.shiftright(at, 33))
    counts = held.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    whole = Window.partitionBy(group)
    earlier = F.sum(size).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, part, first, F.coalesce(earlier, F.lit(0)).alias(before), F.sum(size).over(whole).alias(size))
    out = held.join(broadcast_if_small(counts), [group, part])
    return out.withColumn(place, F.col(at) - F.col(first) + F.col(before)).drop(at, part, first, before)
