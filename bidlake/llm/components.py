"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces a vertex's edges by edges to the smallest vertex near it, and keeps
connectivity; the number of rounds grows with the logarithm of the longest path. Each round is
a partial aggregate and a join, and is written to the shared folder, so no lineage piles up.
A hub's edges meet its one row in the join, narrow rows of two numbers. A salt would spread
them over tasks, but costs three exchanges a round, and that more than it saves; see README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u moves to the smallest vertex among u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v")))


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u, moves to the smallest of those neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def trace(edges: DataFrame) -> tuple:
    """Tells a changed edge table: the number of rows and a sum of their hashes."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all vertices of ``edges`` (u, v longs, no loops); the component is
    its smallest vertex. Null ends are no vertices."""
    current = stage(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()
                                & (F.col("u") != F.col("v")))
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    before = trace(current)
    while True:
        after = stage(small_star(large_star(current)), "edges")
        now = trace(after)  # both steps keep a star forest as it is
        release(current)
        current = after
        if now == before:
            break
        before = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(current.select(
        F.col("v").alias("node"), F.col("v").alias("component")).distinct())
