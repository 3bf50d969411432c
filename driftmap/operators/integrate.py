"""The optimiser's step as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import signed


def step(state: DataFrame, attraction: DataFrame, repulsion: DataFrame, z: DataFrame, eta: float, exaggeration: float, momentum: float) -> DataFrame:
    """New ``id, x, y, ux, uy, gx, gy``; ``z`` is the one-row normaliser."""
    s = state.join(attraction, "id").join(repulsion.select("id", "rx", "ry"), "id").crossJoin(F.broadcast(z))
    for a in "xy":
        s = s.withColumn(f"d{a}", exaggeration * F.col(f"a{a}") - F.col(f"r{a}") / F.col("z"))
    for a in "xy":
        turned = signed(F.col(f"d{a}")) != signed(F.col(f"u{a}"))
        s = s.withColumn(f"g{a}", F.greatest(F.lit(0.01), F.when(turned, F.col(f"g{a}") + 0.2).otherwise(F.col(f"g{a}") * 0.8)))
    for a in "xy":
        s = s.withColumn(f"u{a}", momentum * F.col(f"u{a}") - eta * F.col(f"g{a}") * F.col(f"d{a}"))
    return s.select("id", (F.col("x") + F.col("ux")).alias("x"), (F.col("y") + F.col("uy")).alias("y"), "ux", "uy", "gx", "gy")
