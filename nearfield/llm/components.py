"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.storage import discard, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v) with u > v. Large: every neighbour above a node moves to its least neighbour; small: those below do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component for every node of the undirected edges (a, b) of long ids; component is its least reachable node.

    Every round is written to the shared folder, and neighbour lists are never collected: a node with many links costs rows, not
    memory. Rounds grow with the logarithm of the longest chain; running out of them raises.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now, old = materialise(_stars(_stars(now, True), False), "edges"), now
        discard(old)
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
