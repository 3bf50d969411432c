"""Synthetic points. Draws are hashes of seed, id and dimension, so tables do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(i: Column, k: Column, seed: int, stream: int) -> Column:
    return F.pmod(F.xxhash64(i, k, F.lit(seed), F.lit(stream)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _normal(i: Column, k: Column, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(1 - _unit(i, k, seed, 1))) * F.cos(2 * math.pi * _unit(i, k, seed, 2))


def _table(spark: SparkSession, n: int, dims: int, value, label: Column) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: value(i, k)).alias("features"), label.cast("int").alias("label"))


def uniform(spark: SparkSession, n: int = 5000, dims: int = 50, seed: int = 0) -> DataFrame:
    return _table(spark, n, dims, lambda i, k: _unit(i, k, seed, 0), F.lit(0))


def two_blobs(spark: SparkSession, n: int = 5000, dims: int = 50, seed: int = 0) -> DataFrame:
    """Unit normals around -10 in the first half of the rows, around 10 in the second."""
    half = (F.col("id") >= n // 2).cast("int")
    return _table(spark, n, dims, lambda i, k: _normal(i, k, seed) + half * 20.0 - 10.0, half)


def ten_blobs(spark: SparkSession, n: int = 60_000, dims: int = 50, seed: int = 0) -> DataFrame:
    """Unit normals moved by 12 times the cluster number."""
    label = F.col("id") % 10
    return _table(spark, n, dims, lambda i, k: _normal(i, k, seed) + label * 12.0, label)


def rings(spark: SparkSession, n: int = 5000, seed: int = 0, radius: float = 5.0) -> DataFrame:
    """Two noisy rings in three dimensions, around -10 and 10."""
    half = (F.col("id") >= n // 2).cast("int")
    angle = 2 * math.pi * _unit(F.col("id"), F.lit(-1), seed, 3)
    place = lambda k: F.when(k == 0, radius * F.cos(angle)).when(k == 1, radius * F.sin(angle)).otherwise(0.0)
    return _table(spark, n, 3, lambda i, k: _normal(i, k, seed) + half * 20.0 - 10.0 + place(k), half)
