"""Matrix operators over long tables ``row, col, v`` and over feature arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan_or_inf


def to_long(points: DataFrame) -> DataFrame:
    """``id, features`` to ``row, col, v``."""
    return points.select(F.col("id").alias("row"), F.posexplode("features").alias("col", "v"))


def reduce_alpha(matrix: DataFrame, axis: str, alpha: float = 1.0) -> DataFrame:
    """``alpha`` times the sum along an axis: a value per ``row`` or per ``col``."""
    if axis not in ("row", "col"):
        raise ValueError("axis must be row or col")
    return matrix.groupBy(axis).agg((F.sum("v") * alpha).alias("v"))


def reduce_sum(matrix: DataFrame, axis: str) -> DataFrame:
    return reduce_alpha(matrix, axis, 1.0)


def reduce_mean(matrix: DataFrame, axis: str) -> DataFrame:
    """The sum divided by the number of summands."""
    if axis not in ("row", "col"):
        raise ValueError("axis must be row or col")
    return matrix.groupBy(axis).agg(F.avg("v").alias("v"))


def broadcast_op(matrix: DataFrame, vector: DataFrame, axis: str, op, alpha: float = 1.0) -> DataFrame:
    """``op(v, alpha * vector value)`` for each entry; ``vector`` is ``axis, v``."""
    s = vector.select(axis, (F.col("v") * alpha).alias("s"))
    return matrix.join(s, axis).select("row", "col", op(F.col("v"), F.col("s")).alias("v"))


def max_normalize(df: DataFrame, column: str) -> DataFrame:
    """Divide by the greatest absolute value of the whole table, a one-row aggregate that is broadcast."""
    top = df.agg(F.max(F.abs(column)).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("__top") > 0, F.col(column) / F.col("__top")).otherwise(F.col(column))).drop("__top")


def gaussian_normalize(points: DataFrame) -> DataFrame:
    """Zero mean and unit sample deviation in every dimension; a constant dimension becomes 0.

    The statistics, two numbers per dimension, are one row.
    """
    long = to_long(points)
    per_dim = long.groupBy("col").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    row = per_dim.agg(F.array_sort(F.collect_list(F.struct("col", "m", "s"))).alias("__stats"))
    scale = lambda x, st: F.when(st["s"] > 0, (x - st["m"]) / st["s"]).otherwise(F.lit(0.0))
    return points.crossJoin(F.broadcast(row)).withColumn("features", F.zip_with("features", "__stats", scale)).drop("__stats")


def any_nan_or_inf(points: DataFrame) -> DataFrame:
    """One row: does any coordinate lack a finite value?"""
    return points.agg(F.coalesce(F.bool_or(F.exists("features", nan_or_inf)), F.lit(False)).alias("bad"))


def l2_norm(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the norm of all values of the columns together."""
    total: Column = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    return df.agg(F.sqrt(F.coalesce(F.sum(total), F.lit(0.0))).alias("norm"))


def zero_diagonal(pairs: DataFrame, i: str = "row", j: str = "col", v: str = "v") -> DataFrame:
    return pairs.withColumn(v, F.when(F.col(i) == F.col(j), F.lit(0.0)).otherwise(F.col(v)))


def pack_edges(edges: DataFrame, value: str = "p") -> DataFrame:
    """Edges ``i, j, value`` to a row per i: ``i, js, vs``, by ascending j."""
    cells = F.array_sort(F.collect_list(F.struct("j", value)))
    return edges.groupBy("i").agg(cells.alias("c")).select("i", F.transform("c", lambda c: c["j"]).alias("js"), F.transform("c", lambda c: c[value]).alias("vs"))


def unpack_edges(packed: DataFrame, value: str = "p") -> DataFrame:
    return packed.select("i", F.explode(F.arrays_zip("js", "vs")).alias("c")).select("i", F.col("c.js").alias("j"), F.col("c.vs").alias(value))
