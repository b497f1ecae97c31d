"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch


def _star(pairs: DataFrame) -> DataFrame:
    """Links every neighbour of u to the least of u and its neighbours. pairs: u, v.

    The least neighbour comes from a combining aggregate and goes back by an equi-join with one row per u, which
    adaptive execution splits where u is a hub; no task gathers a hub's neighbours.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long, not null). Returns node, component (the least node reachable) for all nodes of edges.

    Each round is written to the shared folder and the round before it is removed. An edge table without rows gives
    no rows; self-links and repeated edges are harmless.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark, old = None, None
    for _ in range(max_rounds):
        path = scratch(spark, "components")
        pairs.write.parquet(path)
        pairs = spark.read.schema("u long, v long").parquet(path)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            remove(spark, old)
        if now[0] == 0 or now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).groupBy("node").agg(F.min("component").alias("component"))
        mark, old = now, path
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        pairs = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
