"""Connected components of a graph of integer nodes, by alternating large and small stars.

Every round is joins and grouped minima over edges, so no neighbourhood is
gathered in one place, and each round is written to the shared checkpoint
folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component: the smallest node reachable.

    Loops and repeated edges are allowed; an empty table gives an empty one.
    """
    state = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(state)
    while before[0]:
        state = checkpointed(_small_star(_large_star(state)))
        now = print_of(state)
        if now == before:
            break
        before = now
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
