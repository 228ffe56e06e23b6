"""Connected components by alternating large-star and small-star steps, all as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges``: a > b. Each node's neighbours are hung on the node's smallest neighbour (or itself):
    large, those above the node; small, those below it and the node.

    The minimum of a node is an aggregate, combined before the shuffle, and is joined back to the edges: no list of
    neighbours is gathered, and the join of a node with very many edges can be split. Edges pack well, so that a small file of
    them may hold millions: the hint keeps them from being broadcast.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low.hint("merge"), "a")
        out = out.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of its component) for every node of ``edges`` (columns a, b: bigint).

    Nodes without an edge to another node don't appear. Nulls, loops, repeated and reversed edges are harmless.
    Raises if ``rounds`` steps aren't enough; the number needed grows with the logarithm of the largest diameter.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        after = written(_star(_star(now, large=True), large=False), "edges")
        # done when every node hangs on a root that hangs on none, and nothing changed
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        dropped(now)
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
    raise RuntimeError(f"components not stable after {rounds} rounds")
