"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_table, shared_table, skew_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    least = least.select("a", F.least("a", "m").alias("m"), "_n")
    return skew_join(both.where("b > a"), least, ["a"], 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    spread = skew_join(edges, least, ["a"], n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return spread.union(least.select("a", F.col("m").alias("b")))


def component_roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link to a smaller node; root is the smallest node of its component.

    edges holds longs a and b; loops and repeats are allowed. A star's centre meets its edges by broadcast where it
    has a large part of them, so that a node with very many links is no single task. Each half round ends in a table
    in the shared folder, which goes when the next is there.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = shared_table(edges, "edges"), None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        large = shared_table(_large_star(edges, state["n"]).distinct(), "stars")
        drop_table(edges)
        edges = shared_table(_small_star(large, large.count()).distinct(), "edges")
        drop_table(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
