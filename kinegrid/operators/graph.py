"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b", drop: Callable[..., None] | None = None) -> DataFrame:
    """node, component (the least node that it reaches) for every node of an edge. Needs orderable node ids.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each node's neighbours are linked to the least of
    them, so that the edges become stars in a logarithmic number of rounds. A hub's edges are never gathered: the least
    neighbour is a partial aggregate and goes back by a join, whose skew Spark can split. `store` cuts the lineage once a
    round, and `drop` deletes the round before; `edges` should be stored.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    sums = None
    while True:
        # large star: every greater neighbour of u is linked to the least of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u and its lesser neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, store(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if drop:
            drop(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sums:
            break
        sums = now
    root = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)
