"""Connected components: pointer jumping for forests, alternating star rounds for any links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def roots(up: DataFrame, space: Workspace, name: str = "forest") -> DataFrame:
    """(node, component) of every node of ``up`` (node, parent): the end of its way up.

    Each node has one parent and ways never turn back. The length of a way
    halves every round; a round is one join of two written tables.
    """
    held, moved, n = space.save(up.select("node", "parent"), f"{name}-0"), True, 0
    while moved:
        n += 1
        above = held.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = held.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        after, seen = space.counted(jumped, f"{name}-{n}", F.max("moved").alias("moved"))
        space.drop(f"{name}-{n - 1}")
        held, moved = after.select("node", "parent"), seen["moved"]
    return held.withColumnRenamed("parent", "component")


def _large_star(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node).

    The minima are written first: the join then shuffles them by themselves,
    and adaptive execution may split a hub's rows.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = space.save(least, name)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them; edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, space: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it reaches.

    Aggregations combine before their shuffles and a hub's rows meet its
    minimum in a join that adaptive execution can split, so no task holds a
    hub's neighbours. Each round is a written table: lineage stays short and
    a lost executor costs one round. The rounds end when the table's rows and
    the sum of their hashes, taken while it is written, stay as they are.
    """
    state = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    (e, before), n = space.counted(e, f"{name}-0", *state), 0
    while before["n"]:
        n += 1
        e, now = space.counted(_small_star(_large_star(e, space, f"{name}-least-{n}")), f"{name}-{n}", *state)
        space.drop(f"{name}-{n - 1}")
        space.drop(f"{name}-least-{n}")
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
