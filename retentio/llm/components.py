"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join back, so no neighbourhood is gathered in one
place; the edge table is written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())


def connected_components(scratch: Scratch, edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Fails if the edges still change after ``most_rounds`` rounds.
    """
    state = scratch.store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .filter("u != v").distinct(), f"{label}-0")
    before = None
    for turn in range(1, most_rounds + 1):
        state = scratch.store(_small_star(_large_star(state)), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"the components of {label} have not settled after {most_rounds} rounds")
    # Now every edge is (node, smallest node of its component).
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
