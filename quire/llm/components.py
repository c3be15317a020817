"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_staged, staged


def star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """From directed (u, v) and the staged least neighbour m of each u: (u, v, m). Both sides are plain exchanges of
    stored tables, so that Spark can split a hub's pairs over several tasks (an aggregate over the exchange
    would forbid it). least is never broadcast: it grows with the table."""
    return pairs.join(least.hint("merge"), "u")


def least_neighbours(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; a hub's pairs are reduced to a minimum before the shuffle."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least member) of all nodes that `edges` (a, b) link. Loops and repeated edges change
    nothing, edges with a null end count for nothing, no edges give no rows. Rows stay linear in the edges; rounds grow
    with the logarithm of the longest chain; each round ends in a staged table."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = least_neighbours(both)
        large = star(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = staged(large, "down")
        below = least_neighbours(down)
        small = star(down, below).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(below.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "edges")
        for used in (now, least, down, below):
            drop_staged(used)
        now = after
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
