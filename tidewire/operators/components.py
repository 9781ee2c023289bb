"""Connected components by label spreading over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges between node values -> (node, label): label is the smallest node of the node's component.

    Alternating large-star and small-star steps: every step replaces edges by edges to smaller nodes, and the number of
    steps grows with the logarithm of the longest path. Nodes with very many neighbours only ever pass on their minimum.
    """
    current = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of a node are tied to the smallest node around it
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: a node's smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = written(small, "stars")
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    nodes = current.select("u", "v")
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(nodes.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
