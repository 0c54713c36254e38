"""Connected components by alternating star contraction.

Every round is two grouped steps over the edges: each node hangs its larger neighbours, then its
smaller ones, on the smallest node it knows. Edges shrink to stars in a logarithmic number of
rounds. A node with very many neighbours never meets them in one task: the smallest neighbour comes
from an aggregate with map-side combining, and is handed to the edges of such nodes by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_keyed, stored


def _hang(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One contraction. edges: distinct (u, v) with u > v; gives the same kind."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        moved = join_keyed(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hung = join_keyed(edges, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: columns ``a`` and ``b`` of one ordered type. Loops, repeated edges and rows with a null
    are harmless and add nothing. Returns ``node`` and ``component``, one row per node with an edge
    to another node; nodes without one aren't listed. An empty table gives an empty table.
    Raises RuntimeError should ``max_rounds`` not be enough.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # A node under two roots, or a root that hangs itself: then there is work left.
        seen = tuple(now.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen
        now = stored(_hang(_hang(now, True, seen[0]), False, seen[0]), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
