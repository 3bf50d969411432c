"""Points ``id, features`` from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectorise(df: DataFrame, id_col: str = "id", features: str | list[str] = "features") -> DataFrame:
    """``id BIGINT, features ARRAY<DOUBLE>`` from an array column, a nested array, an ML vector, or numeric columns.

    A null or undefined value raises an error when the rows are read.
    """
    if isinstance(features, (list, tuple)):
        values = F.array(*[F.col(c).cast("double") for c in features])
    else:
        kind = df.schema[features].dataType
        if isinstance(kind, T.ArrayType):
            column = F.col(features)
            while isinstance(kind.elementType, T.ArrayType):
                column, kind = F.flatten(column), kind.elementType
            values = F.transform(column, lambda v: v.cast("double"))
        elif kind.typeName() in ("vector", "vectorudt", "udt") or "vector" in kind.simpleString():
            from pyspark.ml.functions import vector_to_array

            values = vector_to_array(F.col(features))
        else:
            values = F.array(F.col(features).cast("double"))
    fine = F.col("id").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("id"), values.alias("features"))
    return out.select("id", F.when(F.coalesce(fine, F.lit(False)), F.col("features")).otherwise(F.raise_error(F.lit("ids and features must be there and finite")).cast("array<double>")).alias("features"))


def check_points(points: DataFrame) -> DataFrame:
    """One row: numbers of points, of distinct ids, and of the least and greatest dimensions."""
    return points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("features")).alias("least_dim"), F.max(F.size("features")).alias("most_dim"))


def from_numpy(spark: SparkSession, x) -> DataFrame:
    """Points of the rows of an array; further axes are flattened."""
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(x, float).reshape(len(x), -1)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"id": np.arange(len(x)), "features": lists}))
