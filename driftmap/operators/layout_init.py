"""First layouts. Draws are hashes of seed and id, so they do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_draw(id_col: Column, seed: int, stream: int) -> Column:
    """A number in [0, 1) from seed, stream and id."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(stream)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def gaussian(points: DataFrame, seed: int = 0, sigma: float = 1e-4) -> DataFrame:
    """``id, x, y`` normal with deviation ``sigma`` (Box-Muller)."""
    r = F.sqrt(-2 * F.ln(1 - unit_draw(F.col("id"), seed, 1))) * sigma
    a = 2 * math.pi * unit_draw(F.col("id"), seed, 2)
    return points.select("id", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def uniform(points: DataFrame, seed: int = 0, low: float = -5.0, high: float = 5.0) -> DataFrame:
    return points.select("id", *[(unit_draw(F.col("id"), seed, k) * (high - low) + low).alias(c) for k, c in ((1, "x"), (2, "y"))])


def vector(points: DataFrame, layout: DataFrame) -> DataFrame:
    """The caller's ``id, x, y``; a point without a place, or with several, is an error when rows are read."""
    given = layout.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("x").cast("double").alias("x"), F.first("y").cast("double").alias("y"))
    ok = (F.col("n") == 1) & F.col("x").isNotNull() & F.col("y").isNotNull()
    checked = lambda c: F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit("the first layout needs one place for each id")).cast("double")).alias(c)
    return points.select("id").join(given, "id", "left").select("id", checked("x"), checked("y"))


def with_state(layout: DataFrame) -> DataFrame:
    """Optimiser state at rest: velocities 0 and gains 1; kept where given, to resume a fit."""
    rest = {"ux": 0.0, "uy": 0.0, "gx": 1.0, "gy": 1.0}
    return layout.select("id", "x", "y", *[F.col(c) if c in layout.columns else F.lit(v).alias(c) for c, v in rest.items()])
