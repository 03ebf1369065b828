"""Connected components of a link table, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .common import drop, write

#: Links that one task takes, once their number is known: it never grows from step to step.
ROWS_A_TASK = 250_000


def _stored(spark: SparkSession, edges: DataFrame) -> tuple[str, tuple]:
    """Write links, and count and sum them up in the same pass."""
    seen = Observation()
    path = write(spark, edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
    return path, (seen.get["n"], seen.get["sum"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots; root is the component's smallest node.

    Every step is two joins of the links with the smallest neighbour of each node, and is written to the shared folder
    in as many tasks as the links need. The steps end when the links stay the same, which they do once all point to
    their root: each step either lowers some node's target or is the last, and their number grows with the logarithm of
    the longest path. Hot nodes are split as skewed joins.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    schema = edges.schema
    path, before = _stored(spark, edges)
    while True:
        edges = spark.read.schema(schema).parquet(path)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        old = path
        path, after = _stored(spark, small.coalesce(-(-before[0] // ROWS_A_TASK)) if before[0] else small)
        drop(spark, old)
        if after == before:
            return spark.read.schema(schema).parquet(path).select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
