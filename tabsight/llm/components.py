"""Connected components of a distributed edge list (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) \
        .withColumnRenamed("a", "_a")
    return both.join(least, F.col("a") == F.col("_a")).filter("b > a") \
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    named = least.withColumnRenamed("a", "_a")
    moved = down.join(named, F.col("a") == F.col("_a")) \
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``node, root``: every node of an edge list with the smallest node of
    its component (nodes are longs).  Each round is checkpointed in the shared
    folder; only a count and a checksum reach the driver."""
    now = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        now = cut_lineage(_small_star(_large_star(now)))
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
