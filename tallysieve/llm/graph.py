"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import stash


def _lowest(pairs: DataFrame) -> DataFrame:
    """(a, low): the smallest of each node's neighbours and itself, from (a, b)."""
    return pairs.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("low")
    )


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("a > b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; nodes without links are left out.

    `pairs` has links (a, b) between long node numbers, in any order, repeated or not. Each
    round is a grouped minimum, combined before the shuffle, and a join; the edge list never
    grows, and it is written to the shared folder after each round. Rounds end when every
    node hangs directly below one that hangs below none.
    """
    edges = stash(_edges(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    while True:
        above = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        chained = edges.join(above.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if above.where("n > 1").limit(1).isEmpty() and chained.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node moves below the smallest one
        large = _edges(
            both.where("b > a").join(_lowest(both).withColumnRenamed("node", "a"), "a").select(
                F.col("b").alias("a"), F.col("low").alias("b")
            )
        )
        large = stash(large, "large-star")
        # small star: a node and its smaller neighbours move below the smallest of these
        lowest = _lowest(large)
        small = large.join(lowest.withColumnRenamed("node", "a"), "a").select(
            F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e")
        )
        edges = stash(_edges(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))), "small-star")
