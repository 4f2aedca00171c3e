"""Steps that several operators share: session settings and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import freeze

#: Shuffle files of a finished step are of no use to later ones, which read
#: the table it has written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker gets at once; texts and sets can be long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(spark: SparkSession) -> SparkSession:
    """Settings of the package's jobs: little disk and memory at a time."""
    spark.conf.set(CLEAN, "true")
    spark.conf.set(BATCH, "1000")
    return spark


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """``(node, component)`` of all nodes of ``links(a, b)``; smallest node wins.

    Large-star and small-star in turn: each round hangs the neighbours of a
    node below the smallest of them, until every node hangs below its
    component's smallest.  A node of many links is only ever reduced to a
    minimum (partial aggregates) and joined, never gathered.  The rounds grow
    with the logarithm of the links; each is written, so lost executors cost
    one round.  Runs jobs while it is built.
    """
    edges = freeze(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    for _ in range(limit):
        if _starred(edges):
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = freeze(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"no end after {limit} rounds")


def _starred(edges: DataFrame) -> bool:
    """Does every node either hang below one other or have nodes below it?"""
    above = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    below = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    roles = above.unionByName(below).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter("up > 1 or up + down > 1").isEmpty()
