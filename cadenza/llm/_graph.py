"""Connected components of a table of links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import discard, stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round, a node takes the smallest label among its neighbours' and its own; the node that was its
    label takes the smallest of what its members have found; then each takes the label of its label. Whole trees so
    move to another root in one round. Labels only fall, and rounds go on until none moves. Labels are
    written after each round; a node with many links is summed before the shuffle.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{name}-0")
    held = labels
    for number in count(1):
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("next"))
        nearer = stage(nearer, f"{name}-near-{number}")
        roots = nearer.groupBy(F.col("label").alias("_root")).agg(F.min("next").alias("_low"))
        hooked = nearer.join(roots, F.col("node") == F.col("_root"), "left").select("node", "label", F.least("next", "_low").alias("next"))
        up = hooked.select(F.col("node").alias("_node"), F.col("next").alias("_next"))
        jumped = hooked.join(up, F.col("next") == F.col("_node"), "left").select("node", F.least("next", "_next").alias("label"), (F.least("next", "_next") < F.col("label")).alias("moved"))
        jumped = stage(jumped, f"{name}-{number}")
        discard(nearer, held)
        held, labels = jumped, jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            break
    discard(both)
    return labels.select("node", F.col("label").alias("component"))
