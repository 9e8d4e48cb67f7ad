"""What can be reached in a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datamove.session import broadcast_if_small, cut_lineage

ROUNDS_IN_PLAN = 16  # the nodes found are written anew after so many rounds, so that no plan grows with the depth


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct `node`s: the seeds and all nodes that edges (a -> b) lead to from them, cycles included. Only nodes found in the round before
    travel on, so each edge is followed once. Null nodes are left out."""
    found = frontier = cut_lineage(seeds.select("node").where("node IS NOT NULL").distinct())
    edges = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    rounds = 0
    while not frontier.isEmpty():
        led = edges.join(broadcast_if_small(frontier), F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct()
        frontier = cut_lineage(led.join(found, "node", "left_anti"))
        found, rounds = found.unionByName(frontier), rounds + 1
        if rounds % ROUNDS_IN_PLAN == 0:
            found = cut_lineage(found)
    return found
