"""Connected components by alternating large-star and small-star rounds (DataFrame operations).

Every round is one written table, so a lost executor repeats a round at most.
Node degrees only meet in a minimum (combined before the shuffle) and in a join
that adaptive execution can split, or to which the minima are broadcast if they are few.
Links that come later are tied between the components that are known (``extended``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

#: Minima of at most so many bytes are broadcast, and edges of no more nodes than that gathered by so many tasks.
FEW_BYTES, FEW_TASKS = 8 << 20, 8


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table of two longs a row, of at most so many rows, for broadcast if that is little."""
    return F.broadcast(df) if rows * 24 <= FEW_BYTES else df


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One operation on at most n edges (u, v) with v < u; what comes out may repeat edges, but is no more than edges and nodes."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n)
    if large:  # neighbours above u go to u's minimum
        moved = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # neighbours below u, and u, go to u's minimum
        moved = both.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v")


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that keep them from being stars: those above two others, or above one and below another)."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("over"), F.lit(0).alias("under")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    nodes = ends.groupBy("x").agg(F.sum("over").alias("over"), F.max("under").alias("under"))
    bad = F.when((F.col("over") > 1) | ((F.col("over") > 0) & (F.col("under") > 0)), 1).otherwise(0)
    return tuple(x or 0 for x in nodes.agg(F.sum("over"), F.sum(bad)).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes in edges(u, v); either order, repeats allowed."""
    now = scratch.store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )

    n, bad = _unsettled(now)
    while bad:
        # the large star's output has at most n edges, as its input
        after = _star(_star(now, True, n), False, n).distinct()
        after = scratch.store(after.coalesce(FEW_TASKS) if 2 * n * 24 <= FEW_BYTES else after, "stars")
        scratch.drop(now)
        now = after
        n, bad = _unsettled(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def labelled(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of a column's node in the stored table found(node, component); a node that is not there is its own."""
    there = small(found.select(F.col("node").alias(column), F.col("component").alias(name)))
    return rows.join(there, column, "left").withColumn(name, F.coalesce(name, column))


def extended(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored table found(node, component) after further links (u, v): only ties between different components go through rounds."""
    ends = labelled(labelled(links.select("u", "v"), found, "u", "_cu"), found, "v", "_cv").where("_cu <> _cv")
    ties = scratch.store(ends.select(F.greatest("_cu", "_cv").alias("u"), F.least("_cu", "_cv").alias("v")).distinct(), "ties")
    n = ties.count()
    if not n:
        return found
    moved = components(ties, scratch)
    there = _few(moved.select(F.col("node").alias("component"), F.col("component").alias("_to")), 2 * n)
    old = found.join(there, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = moved.join(small(found.select("node")), "node", "left_anti")
    return scratch.store(old.unionByName(new), "components")
