"""Connected components of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.skew import HOT_ROWS, join_counted


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame, hot_rows: int, total: int) -> DataFrame:
    """Link every higher neighbour of a node to the lowest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(
        F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("degree")
    )
    met = join_counted(both, lowest, "a", "degree", hot_rows, total).where("b > a")
    return met.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, hot_rows: int, total: int) -> DataFrame:
    """Link every lower neighbour of a node, and the node, to the lowest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
    met = join_counted(edges, lowest, "a", "degree", hot_rows, total).where("b <> low")
    moved = met.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its lowest node.

    Alternating large and small stars (Kiveris et al., SoCC 2014) built from aggregates and
    joins: no neighbour list is ever collected, so a hub may have any number of links. Every
    round is a written table; the loop ends when a round changes nothing.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()
    current = materialise(current, "links")
    state = _checksum(current)
    while True:
        large = materialise(_large_star(current, hot_rows, 2 * state[0]), "large-star")
        current = materialise(_small_star(large, hot_rows, 2 * state[0]), "small-star")
        after = _checksum(current)
        if after == state:
            break
        state = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
