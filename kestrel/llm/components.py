"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import discarded, shuffles_dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    others = joined.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return others.union(least.select("m", "b")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of the pairs (a, b), a < b.

    Each round is written to the shared folder and the one before deleted; the rounds grow with the logarithm of the
    components' diameter. Only two figures of a round reach the driver.
    """
    edges = written(edges, "edges")
    before = None
    while True:
        with shuffles_dropped(edges.sparkSession):
            now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before, last = now, edges
        edges = written(_small_star(_large_star(last)), "edges")
        discarded(last)
