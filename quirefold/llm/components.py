"""Connected components of an edge table, without hot keys or a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Rounds before giving up with an error. Alternating stars need some log2 of the longest path squared; 100 rounds are
#: far beyond that for any table.
MAX_ROUNDS = 100


def _keyed(rows: DataFrame) -> DataFrame:
    """With a second key that follows from the first: a join on both shuffles both sides for itself, which is what lets
    Spark split a partition that one node fills."""
    return rows.withColumn("k", F.xxhash64("a"))


def _round(now: DataFrame) -> DataFrame:
    # Large star: neighbours above a node move to the smallest node around it.
    both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = _keyed(both.where("b > a")).join(_keyed(least), ["a", "k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.where("a = b")).distinct()
    # Small star: neighbours below a node, and the node, move to the smallest of them.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    down = _keyed(large).join(_keyed(low), ["a", "k"]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return down.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing moves; raises an error if that takes more than MAX_ROUNDS.
    A node's smallest neighbour is a partial aggregate and comes back by a join that Spark can split, so a node with
    very many edges is no single task. Self-edges only say that a node exists. No edges, no rows.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        following = stash(_round(now), "edges")
        drop_stash(now)
        now, state = following, following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
