"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import apart_long, staged


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours v. The join deals a hub's edges over several tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(apart_long("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.withColumn("k", F.col("u")).join(least, "k")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no u with two of them, and none that is another's v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").limit(1).count()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node with an edge, root being the smallest node of its component.

    edges has long columns u and v; loops, repeats and either direction are fine. Each round is written to the shared
    folder; rounds grow with the logarithm of the number of nodes, and stars, which most components are, take none.
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _settled(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node has few smaller neighbours by now: a window needs one shuffle where the join takes three
        held = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = held.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(held.select("u", F.col("m").alias("v"))).distinct()
        now = staged(small, name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
