"""Publish the steps of a fit to a folder, and watch them with Structured Streaming."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = "step int, id long, x double, y double"


class FolderPublisher:
    """An observer for ``plans.fit.fit``: each kept step becomes Parquet files in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, kind: str, step: int, ids: np.ndarray, y: np.ndarray) -> None:
        table = pa.table({"step": pa.array([step] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()), "x": y[:, 0].copy(), "y": y[:, 1].copy()})
        self.spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(self.folder)


def publish(trajectory: DataFrame, folder: str) -> None:
    """Append finished steps to a published folder."""
    trajectory.select("step", "id", "x", "y").write.mode("append").parquet(folder)


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A streaming table of the published steps."""
    return spark.readStream.schema(STEPS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def step_summary(steps: DataFrame) -> DataFrame:
    """Per step: points, bounds and centre; works on streams (complete or update mode) and tables."""
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("x"), F.min("y")).alias("low"), F.greatest(F.max("x"), F.max("y")).alias("high"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def run_to_end(summary: DataFrame, output_mode: str = "complete") -> DataFrame:
    """Run a streaming table over what is there now; its last result as a table."""
    name = f"steps_{uuid.uuid4().hex[:12]}"
    query = summary.writeStream.outputMode(output_mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return summary.sparkSession.table(name)
