"""Connected components of a graph that is a table of edges, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _roots(tree: DataFrame, tasks: int) -> DataFrame:
    """tree (v, label), where labels are vertices that are not larger: (v, label) with the end of each chain, by pointer doubling."""
    tree = checkpointed(tree.coalesce(tasks))
    while True:
        above = tree.select(F.col("v").alias("label"), F.col("label").alias("next"))
        tree = checkpointed(tree.join(above, "label").select("v", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")).coalesce(tasks))
        if tree.filter("moved").isEmpty():
            return tree.select("v", "label")


def components(edges: DataFrame, max_rounds: int = 200, rows_per_task: int = 200_000) -> DataFrame:
    """edges (a, b) -> (v, label): label is the smallest vertex of v's component. Vertices without edges are not
    there. Each round hooks every vertex to its smallest neighbour, if that is smaller, follows the hooks to their ends, and
    contracts: edges go on between the ends that they join, once each, and those inside are gone. So all edges are read in
    the first round only, and a dense group costs its links once, not in every round. Each round is a reliable
    checkpoint; nothing is collected but the count of edges. The rounds' tasks follow the number of edges, as a few edges
    in as many tasks as the session shuffles into cost their overhead again in every round."""
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, left = None, edges.count()
    for _ in range(max_rounds):
        tasks = left // rows_per_task + 1
        both = edges.select(F.col("a").alias("v"), "b").union(edges.select(F.col("b").alias("v"), F.col("a").alias("b")))
        roots = _roots(both.groupBy("v").agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("label")), tasks)
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("v").alias("label"), F.col("label").alias("new"))
            labels = checkpointed(labels.join(moved, "label", "left").select("v", F.coalesce("new", "label").alias("label")))
        joined = edges.join(roots.select(F.col("v").alias("a"), F.col("label").alias("x")), "a")
        joined = joined.join(roots.select(F.col("v").alias("b"), F.col("label").alias("y")), "b").filter("x <> y")
        edges = checkpointed(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(tasks))
        left = edges.count()
        if not left:
            return labels
    raise RuntimeError("components did not settle")
