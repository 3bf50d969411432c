"""Joint affinities from conditional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(edges: DataFrame) -> DataFrame:
    """Edges and their mirrors, each edge once: ``i, j, p`` is the sum of both, ``own`` whether the edge itself exists."""
    mirror = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "p", F.lit(False).alias("own"))
    return edges.select("i", "j", "p", F.lit(True).alias("own")).unionByName(mirror).groupBy("i", "j").agg(F.sum("p").alias("p"), F.bool_or("own").alias("own"))


def one_sided(edges: DataFrame, n: int) -> DataFrame:
    """(p_ij + p_ji) / 2n on the edges that exist; the mirror of an edge that is missing counts 0.

    Edges meet their mirrors in an aggregate, so that no side of a join is sent through the driver.
    """
    return _both(edges).where("own").select("i", "j", (F.col("p") / (2 * n)).alias("p"))


def full(edges: DataFrame, n: int) -> DataFrame:
    """(p_ij + p_ji) / 2n on the edges and their mirrors; sums to 1."""
    return _both(edges).select("i", "j", (F.col("p") / (2 * n)).alias("p"))


def symmetrize(edges: DataFrame, n: int, mode: str = "one_sided") -> DataFrame:
    if mode not in ("one_sided", "full"):
        raise ValueError("mode must be one_sided or full")
    return one_sided(edges, n) if mode == "one_sided" else full(edges, n)
