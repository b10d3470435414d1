"""Connected components of a distributed edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's least node.

    Large-star links a node's greater neighbours to the least node it sees, small-star
    its lesser ones; the edges become stars after about log2(longest path) rounds.
    Each round is an aggregation and a join by node, staged so that lineage stays short."""
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), folder, f"{name}-0")
    mark, i = None, 0
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.union(now.select(F.greatest("a", "b"), F.least("a", "b"))).filter("a <> b").distinct() \
            if mark is None else large.filter("a <> b").distinct()
        down = down.toDF("u", "v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        i += 1
        now = stage(small.filter("a <> b").distinct(), folder, f"{name}-{i}")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
