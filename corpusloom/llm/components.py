"""Connected components of a graph held as a table of edges: alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and an equi-join that Spark may split where a hub is
skewed. Each round is written to the shared folder, which cuts the lineage. Only whether all groups are stars comes to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, written


def are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or smaller ones and larger ones: then every group is a star."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): each node that has an edge, with the smallest node it can reach."""
    now = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    while not are_stars(now):
        # large star: every neighbour larger than a node moves to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(spark, both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges", narrow=True)
        # small star: every node and its smaller neighbours move to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        then = written(spark, moved.distinct(), "edges", narrow=True)
        forget(spark, now, large)
        now = then
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
