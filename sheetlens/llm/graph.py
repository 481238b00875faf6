"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    Large: every node points its larger neighbours to the smallest of its neighbours and
    itself. Small: every node points its smaller neighbours and itself to the smallest. The
    minimum is aggregated in each task first and joined back, so a node with very many
    neighbours is a skewed join that can be split, never a group in one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # one row per edge; repeated ones go with the small star
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges(src, dst)`` that has a link.

    Ids are longs. Null ends and links of a node to itself are left out; repeated links count
    once. Each round is cut from its lineage by a checkpoint; it ends when a round changes
    nothing, and raises if ``most_rounds`` do not suffice.
    """
    now = saved(
        edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = now.agg(*mark).first()
    for _ in range(most_rounds):
        if not before.n:
            break
        now = saved(_star(_star(now, large=True), large=False))
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
