"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_by_size, staged


def _star(edges: DataFrame, both_ways: bool, total: int) -> DataFrame:
    """Links each neighbour of a node to the least of the node and its neighbours.

    ``both_ways``: of all neighbours, those above the node (large star); else of those below it and itself (small star).
    ``total``: edges, or more. A node with very many of them is joined by broadcast.
    """
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("peer"))
    seen = down.union(down.select("peer", "node")) if both_ways else down
    least = seen.groupBy("node").agg(F.min("peer").alias("low"), F.count("*").alias("n")).select("node", F.least("node", "low").alias("low"), "n")
    out = join_by_size(seen, least, ["node"], "n", total, how="inner")
    if both_ways:
        return out.where("peer > node").select(F.col("peer").alias("a"), F.col("low").alias("b"))
    own = least.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return out.select(F.col("peer").alias("a"), F.col("low").alias("b")).union(own)


def connected(edges: DataFrame) -> DataFrame:
    """node, root: for each node of ``edges`` (longs a, b) the least node of its component.

    No edges give no rows. Each half of a round writes its edges as a table; only their number and checksum reach the driver. Once a round changes
    nothing, every component is a star around its least node. Rounds grow with the logarithm of the longest path.
    """
    clean = lambda e: e.where("a != b").distinct()
    now, before = staged(clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, old = mark, now
        half = staged(clean(_star(now, True, 2 * mark[0])), "large-star")
        now = staged(clean(_star(half, False, mark[0])), "edges")
        discard(old, half)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
