"""Connected components of an edge list, distributed.

Alternating star contraction: every node points its larger neighbours at its
least one, then its smaller neighbours and itself. Each round is two
partial-aggregate shuffles over narrow rows and is written to the shared
folder, so lineage stays short; the number of rounds grows with the logarithm
of the longest path. A star's centre is spread over tasks by map-side minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``a, b`` edges; ``large`` chooses which neighbours move."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join below is of two exchanges and a hot centre can be split
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    moved = both.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its least node) for every node of ``a, b`` edges."""
    # written first: whatever makes the edges runs once
    edges = materialise(edges.select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = edges.where("a <> b")
    mark = None
    for _ in range(max_rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
