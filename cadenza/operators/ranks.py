"""Places and running sums in an order over whole groups, in as many tasks as the data asks.

Rows are cut into sorted ranges over all groups (a range partition) and written; sums of each range and group, of which there are as many as ranges and groups, give what comes before it. A
window then runs within a range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.tables import settled


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, total: str) -> DataFrame:
    """df with the running sum of value (never null) over its group in the order, the row itself included, and the group's sum. Null keys are groups too."""
    ranged = df.withColumn("_value", value).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = settled(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    held = held.withColumn("_group", key)
    sums = held.groupBy("_group", "_part").agg(F.sum("_value").alias("_own"))
    group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_group", "_part", before.alias("_before"), F.sum("_own").over(group).alias(total))
    within = F.sum("_value").over(Window.partitionBy("_group", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = held.withColumn("_run", within).join(offsets, ["_group", "_part"])
    return out.withColumn(name, F.col("_run") + F.col("_before")).drop("_value", "_at", "_part", "_group", "_run", "_before")


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "pos", total: str = "n") -> DataFrame:
    """df with the place of each row in its group, from 0, and the group's size."""
    return running(df, by, order, F.lit(1).cast("long"), name, total).withColumn(name, F.col(name) - 1)


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each distinct value of a group: r, the share of its rows that are no greater, g, of those no smaller, and n rows of the group. A value that many rows share is one
    row before anything is sorted."""
    kinds = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    out = running(kinds, by, [value], F.col("_c"), "_le", "n")
    return out.select(*by, value, (F.col("_le") / F.col("n")).alias("r"), ((F.col("n") - F.col("_le") + F.col("_c")) / F.col("n")).alias("g"), "n", "_c")
