"""Connected components of a table of edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import materialised

JUMPS = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that can be reached.

    Every round hooks each node to its smallest neighbour, shortens the chains of hooks, and replaces the ends of all edges
    by what they hang on; edges within one tree fall away, so the table shrinks by at least half a round. Each round ends
    with written tables, so a lost executor repeats one round at most.
    """
    labels = materialised(
        edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "nodes"
    ).select("node", F.col("node").alias("root"))
    left = materialised(edges.where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hooks = materialised(hooks.select("a", "up"), "hooks")
        for _ in range(JUMPS):
            above = hooks.select(F.col("a").alias("up"), F.col("up").alias("above"))
            hooks = hooks.join(above, "up").select("a", F.col("above").alias("up"))
        hooks = materialised(hooks, "hooks")
        at = hooks.select(F.col("a").alias("root"), F.col("up"))
        labels = materialised(
            labels.join(at, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels"
        )
        of_a, of_b = hooks.select("a", F.col("up").alias("x")), hooks.select(F.col("a").alias("b"), F.col("up").alias("y"))
        left = materialised(
            left.join(of_a, "a").join(of_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "edges",
        )
    return labels
