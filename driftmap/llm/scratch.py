"""Tables written in the cluster's shared folder to cut lineage.

A written table survives lost executors (every task can reread it), gives the
optimizer real sizes, and stops text from being scanned twice. The folder is
the one the cluster names in ``spark.checkpoint.dir``; a local session without
that setting gets a folder of its own under the temp directory.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..scratch_tables import shared_folder

_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique() -> str:
    return uuid.uuid4().hex


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def dropped(spark: SparkSession):
    """Delete, at the end, the scratch tables written inside. Results that use them must be stored by then."""
    before = len(_written)
    yield
    for path in _written[before:]:
        delete(spark, path)
    del _written[before:]


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
