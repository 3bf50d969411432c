"""Text dumps of layouts over steps: a header line ``N 2``, then N lines ``x y`` per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_text(trajectory: DataFrame, path: str) -> None:
    """Write ``step, id, x, y`` as a folder of text parts, in order of step and id."""
    spark = trajectory.sparkSession
    n = trajectory.select(F.count_distinct("id")).first()[0]
    head = spark.range(1).select(F.lit(-1).alias("step"), F.lit(-1).cast("long").alias("id"), F.lit(f"{n} 2").alias("line"))
    rows = trajectory.select("step", "id", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("line"))
    head.unionByName(rows).orderBy("step", "id").select("line").write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``frame, idx, x, y`` of a dump, whatever parts or splits it is read in."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    split = W.partitionBy("file", "block")
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c"))
    starts = sizes.select("file", "block", (F.sum("c").over(W.partitionBy(F.lit(1)).orderBy("file", "block").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("start"))
    numbered = lines.withColumn("k", F.row_number().over(split.orderBy("m")) - 1).join(F.broadcast(starts), ["file", "block"]).select((F.col("start") + F.col("k")).alias("line"), "value")
    n = numbered.where("line = 0").select(F.split("value", " ")[0].cast("long").alias("n"))
    parts = F.split("value", " ")
    rows = numbered.where("line > 0").crossJoin(F.broadcast(n))
    at = F.col("line") - 1
    return rows.select(F.floor(at / F.col("n")).cast("int").alias("frame"), (at % F.col("n")).alias("idx"), parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))


def plot_table(layout: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, x, y, label``, ready to draw."""
    return layout.join(labels.select("id", "label"), "id", "left")
