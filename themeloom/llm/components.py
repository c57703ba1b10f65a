"""Connected components of an edge table by hooking and contracting.

In each round every node hooks to the neighbour (or itself) that comes first in
that round's random order, edges are renamed to the hooks, and edges inside one
hook vanish. The order changes each round, so long chains shrink by a constant
factor per round on average, however the ids are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(src, dst)``; nodes of a component share a root.

    Null ends and loops are ignored. The hook of a node is an aggregate with
    partial sums in the map tasks; the joins with the unique hooks are ordinary
    sort-merge joins, whose hot keys Spark splits. Every round is cut into the
    shared folder.
    """
    work = cut(edges.select("src", "dst").where("src <> dst").distinct())
    labels = None
    turn = 0
    while not work.isEmpty():
        sides = work.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            work.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("o"), F.col(c).alias("id"))
        hooks = cut(
            sides.groupBy("node")
            .agg(F.min(order("other")).alias("best"))
            .select("node", F.least("best", order("node")).getField("id").alias("hook"))
        )
        if labels is None:
            labels = hooks.select("node", F.col("hook").alias("root"))
        else:
            labels = cut(_renamed(labels, hooks, "root"))
        work = cut(
            _renamed(_renamed(work, hooks, "src"), hooks, "dst").where("src <> dst").distinct()
        )
        turn += 1
    if labels is None:
        labels = work.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return labels


def _renamed(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    table = hooks.select(F.col("node").alias("_node"), F.col("hook").alias("_hook"))
    return (
        rows.join(table, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_hook", column))
        .drop("_node", "_hook")
    )
