"""Image and array files as points.

Files are read with Spark's ``binaryFile``, so any store that Spark reads will
do; the records of a file are cut in the task that reads it.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: magic numbers, header bytes, label bytes and pixels of a record.
IDX_IMAGES, IDX_LABELS = 2051, 2049
CIFAR_PIXELS = 3072
POINTS = "file string, idx long, features array<double>"


def _batches(file: str, values: np.ndarray, step: int = 1024):
    for lo in range(0, len(values), step):
        part = values[lo : lo + step]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(lo, lo + len(part))), lists], ["file", "idx", "features"])


def _read(spark: SparkSession, path: str, cut) -> DataFrame:
    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                yield from _batches(file.as_py(), cut(content.as_py()))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, POINTS)


def _numbered(rows: DataFrame) -> DataFrame:
    """Ids from 0 over all files in order of their names."""
    from pyspark.sql import Window as W

    sizes = rows.groupBy("file").agg((F.max("idx") + 1).alias("n"))
    starts = sizes.select("file", (F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    return rows.join(F.broadcast(starts), "file").select((F.col("start") + F.col("idx")).alias("id"), "features")


def idx_images(spark: SparkSession, path: str, scale: float = 255.0) -> DataFrame:
    """``id, features`` of an IDX3 image file, pixels divided by ``scale``."""

    def cut(content: bytes) -> np.ndarray:
        magic, count, rows, cols = np.frombuffer(content, ">i4", 4)
        if magic != IDX_IMAGES:
            raise ValueError("not an IDX image file")
        return np.frombuffer(content, np.uint8, count * rows * cols, 16).reshape(count, rows * cols) / scale

    return _numbered(_read(spark, path, cut))


def idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """``id, label`` of an IDX1 label file."""
    rows = _numbered(_read(spark, path, lambda c: np.frombuffer(c, np.uint8, -1, 8).reshape(-1, 1).astype(float)))
    return rows.select("id", F.element_at("features", 1).cast("int").alias("label"))


def cifar(spark: SparkSession, path: str, label_bytes: int = 1, scale: float = 255.0) -> DataFrame:
    """``id, features, label`` of CIFAR files: 1 label byte per record for CIFAR-10, 2 for CIFAR-100 (the last one counts)."""
    size = label_bytes + CIFAR_PIXELS

    def cut(content: bytes) -> np.ndarray:
        if len(content) % size:
            raise ValueError("not a file of whole records")
        records = np.frombuffer(content, np.uint8).reshape(-1, size)
        return np.concatenate([records[:, label_bytes - 1 : label_bytes], records[:, label_bytes:] / scale], axis=1)

    rows = _numbered(_read(spark, path, cut))
    return rows.select("id", F.slice("features", 2, CIFAR_PIXELS).alias("features"), F.element_at("features", 1).cast("int").alias("label"))


def npz(spark: SparkSession, path: str, key: str = "x_train", n: int | None = None) -> DataFrame:
    """``id, features`` of an array in an npz file, ``key`` or the first one; the first ``n`` rows if given."""

    def cut(content: bytes) -> np.ndarray:
        with np.load(io.BytesIO(content)) as held:
            x = held[key if key in held.files else held.files[0]]
        return x.reshape(len(x), -1)[:n].astype(float)

    return _numbered(_read(spark, path, cut))


def save_points(points: DataFrame, path: str) -> None:
    points.write.parquet(path)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
