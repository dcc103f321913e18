"""Connected components on Spark: alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import stored


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node: an aggregate that combines before the shuffle, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return _oriented(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = _smallest(edges)
    handed = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(handed.unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node of its component.

    Edges may repeat and point either way; loops and null ends are ignored; no edges give no rows. Each
    round is written to the shared folder; only two numbers a round reach the driver. Rounds
    grow with the logarithm of the largest component.
    """
    now = stored(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
