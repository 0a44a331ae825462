"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is one node of its component.

    Every round joins each node to its smallest neighbour and contracts the graph, which for random node
    numbers at least halves it; the rounds' maps are then followed from the first to the last. Only table
    sizes come to the driver. An empty table gives an empty table.
    """
    edges = settle(_both(edges), "cc-edges")
    maps = []
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min("b").alias("b"))
        step = settle(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "cc-map")
        maps.append(step)
        ends = edges.where("a < b").join(step.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        edges = settle(_both(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "cc-edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0].withColumnRenamed("to", "root")
    for step in maps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("to").alias("next"))
        roots = roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return settle(roots, "cc-roots")


def _both(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(turned).where("a <> b").distinct()
