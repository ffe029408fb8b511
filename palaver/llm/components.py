"""Connected components of an edge table, by joins and group-bys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import settled

ROUNDS = 100  # rounds after which the graph counts as broken; the number of rounds grows as the logarithm of a path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b): the smallest node it can reach.

    Every round links each node to the smallest node among its neighbours (large star, then small
    star), which halves the length of paths. The edge table never holds more rows than it began
    with, apart from its copies in both directions. A node with very many neighbours is only
    aggregated over, never collected. Each round is written to the shared folder, so a lost
    executor costs one round. Null ends are left out; an empty table gives no rows.
    """
    edges = settled(
        edges.select("a", "b").filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = _digest(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: neighbours larger than the node link to the smallest one around it
        large = (
            both.filter(F.col("b") > F.col("a")).join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        large = settled(large, "links")
        # small star: the node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        after = settled(
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(small.select("a", F.col("low").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct(),
            "links",
        )
        before, state = state, _digest(after)
        if state == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        edges = after
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")


def _digest(edges: DataFrame):
    """Number and hash sum of the edges: equal for equal sets."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
