"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datamove.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): each node of an edge with the smallest node it can reach.

    Alternating large-star and small-star steps: every step hangs a node's neighbours on the smallest one, as a partly aggregated minimum
    and a join back that adaptive execution can split, so a node with very many edges is never gathered. Each step's edges are
    checkpointed; their number never grows. Null ends, loops and repeated edges are dropped; no edges give no rows.
    """
    links = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = cut_lineage(small)
        # a forest of stars: no node is both a child and a parent, and no child has two parents
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("parents"), F.lit(False).alias("root")).unionByName(
            after.select(F.col("v").alias("node"), F.lit(0).alias("parents"), F.lit(True).alias("root")))
        done = (ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("root").alias("root"))
                .where("parents > 1 OR (parents > 0 AND root)").isEmpty())
        links = after
        if done:
            break
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
