"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.llm.common import new_folder

_MOST_ROUNDS = 100


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``); the component is its smallest node.

    Each round is two aggregations; every round's edges are written, so the lineage stays short.  A node keeps
    no list of its neighbours in memory: only their minimum is aggregated, then joined.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = _written(edges, "edges")
    for _ in range(_MOST_ROUNDS):
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        after = _written(small.filter("a <> b").distinct(), "edges")
        # Stars whose centres are no one's member are the components.
        done = after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        twice = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        edges = after
        if done and twice:
            break
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
