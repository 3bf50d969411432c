"""Summaries of repeated timed runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def time_runs(spark: SparkSession, configs: Iterable[str], run: Callable[[str], object], repeats: int = 3) -> DataFrame:
    """``config, repeat, seconds``; a first run of each config is dropped as warm-up."""
    rows = []
    for config in configs:
        for k in range(repeats + 1):
            began = time.perf_counter()
            run(config)
            if k:
                rows.append((config, k, time.perf_counter() - began))
    return spark.createDataFrame(rows, "config string, repeat int, seconds double")


def summarise(runs: DataFrame, config: str = "config", value: str = "seconds") -> DataFrame:
    """Mean and population deviation per config, undefined values left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return runs.groupBy(config).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def fastest(summary: DataFrame, config: str = "config") -> DataFrame:
    """One row: the config of least mean."""
    return summary.agg(F.min_by(config, F.struct("mean", config)).alias(config), F.min("mean").alias("mean"))
