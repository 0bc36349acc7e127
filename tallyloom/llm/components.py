"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import discard, written


def _large_star(edges: DataFrame, kept: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(
        F.col("high").alias("node"), F.col("low").alias("other")
    )
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    least, path = written(least, "least")  # so that the join stands alone and a node with very many edges can be split
    kept.append(path)
    return (
        both.join(least, "node").where(F.col("other") > F.col("node"))
        .select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
    )


def _small_star(edges: DataFrame, kept: list[str]) -> DataFrame:
    least, path = written(edges.groupBy("high").agg(F.min("low").alias("least")), "least")
    kept.append(path)
    moved = edges.join(least, "high").where(F.col("low") != F.col("least")).select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.withColumnRenamed("least", "low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(high, low) edges of long ids, high > low -> (node, component): the smallest id reachable, for every
    node that is not itself the smallest.

    Each half of a round and its table of least neighbours are written to the shared folder and what is no longer read
    is deleted, so the lineage stays short and the disk holds two rounds. A node with very many edges is one row on the
    small side of the join, whose other side adaptive execution splits. No edges give no rows.
    """
    spark = edges.sparkSession
    now, path = written(edges.distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("high").alias("node"), F.col("low").alias("component"))
        before, done = state, [path]
        half, path = written(_large_star(now, done), "edges")
        done.append(path)
        now, path = written(_small_star(half, done), "edges")
        for old in done:
            discard(spark, old)
