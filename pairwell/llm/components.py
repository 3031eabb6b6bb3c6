"""Connected components of a graph given as edges, by alternating stars.

Each round relinks every node to its least neighbour (large star), then the
smaller neighbours of a node among themselves (small star), until no edge
changes. Rounds are logarithmic in practice; every round is a table in the
shared folder, so lost executors cost a stage, not the run. Nothing is
collected but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label, the least node of its component, for each node that has an edge.

    edges: columns u and v, whole numbers, without nulls; loops and repeats may occur.
    """
    current = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(current)
    for _ in range(rounds):
        current = materialize(_small_star(_large_star(current)), "edges")
        before, state = state, _state(current)
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
