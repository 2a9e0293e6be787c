"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v.

    large: every node hands its larger neighbours to its smallest neighbour;
    small: every node hands its smaller neighbours and itself to the smallest of them.
    The minimum is a pre-aggregated group, so a hub costs one row a task before the join,
    and the join itself is one that adaptive execution can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one integer type).

    root is the smallest node reachable. Nodes without an edge to another node aren't returned; nulls and loops are
    ignored. Rounds double the reach, so ``max_rounds`` is a guard only: reaching it raises.
    """
    links = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        links = cut(_star(_star(links, True), False))
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = (row[0], row[1])
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
