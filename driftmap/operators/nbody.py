"""Potentials by interpolation on a grid.

The grid has a fixed number of nodes whatever the number of points, so the
weights per node, the convolution and the broadcast of its result are bounded;
points meet the grid in a map or an equi-join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import N_BOXES, ONE_PLACE, box_width, convolve, smooth_boxes
from ..functions.scalar import squared_cauchy


def bounds(layout: DataFrame) -> DataFrame:
    """One row ``low, high`` over both coordinates together."""
    return layout.agg(F.least(F.min("x"), F.min("y")).alias("low"), F.greatest(F.max("x"), F.max("y")).alias("high"))


def _width(boxes: int) -> Column:
    return F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / boxes).otherwise(F.lit(ONE_PLACE))


def box_index(layout: DataFrame, boxes: int = N_BOXES) -> DataFrame:
    """``id, ix, iy, tx, ty``: the box of each point, and its place in the box, in box widths."""
    b = layout.crossJoin(F.broadcast(bounds(layout).select("low", _width(boxes).alias("w"))))
    at = lambda c: (F.col(c) - F.col("low")) / F.col("w")
    box = lambda c: F.least(F.greatest(F.floor(at(c)), F.lit(0)), F.lit(boxes - 1)).cast("int")
    return b.select("id", box("x").alias("ix"), box("y").alias("iy"), (at("x") - box("x")).alias("tx"), (at("y") - box("y")).alias("ty"))


def box_bounds(layout: DataFrame, boxes: int = N_BOXES) -> DataFrame:
    """``ix, iy, x0, x1, y0, y1``: the corners of every box."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(boxes - 1)))
    b = bounds(layout).select("low", _width(boxes).alias("w")).withColumn("ix", axis).withColumn("iy", axis)
    edge = lambda c, k: F.col("low") + (F.col(c) + k) * F.col("w")
    return b.select("ix", "iy", edge("ix", 0).alias("x0"), edge("ix", 1).alias("x1"), edge("iy", 0).alias("y0"), edge("iy", 1).alias("y1"))


def kernel_grid(layout: DataFrame, boxes: int = N_BOXES) -> DataFrame:
    """``kx, ky, k``: the squared Cauchy kernel at every offset of two nodes."""
    lag = F.explode(F.sequence(F.lit(0), F.lit(3 * boxes - 1)))
    b = bounds(layout).select((_width(boxes) / 3).alias("h")).withColumn("kx", lag).withColumn("ky", lag)
    return b.select("kx", "ky", squared_cauchy(F.col("kx") * F.col("h"), F.col("ky") * F.col("h")).alias("k"))


def lagrange(t: Column) -> list[Column]:
    """Weights of the nodes at 1/6, 1/2 and 5/6 of a box."""
    a, b, c = (F.lit(v) for v in (1 / 6, 1 / 2, 5 / 6))
    return [(t - b) * (t - c) / ((a - b) * (a - c)), (t - a) * (t - c) / ((b - a) * (b - c)), (t - a) * (t - b) / ((c - a) * (c - b))]


def lagrange_weights(boxed: DataFrame) -> DataFrame:
    wx, wy = lagrange(F.col("tx")), lagrange(F.col("ty"))
    return boxed.select("id", *[w.alias(f"{axis}{k + 1}") for axis, ws in (("wx", wx), ("wy", wy)) for k, w in enumerate(ws)])


def node_weights(boxed: DataFrame) -> DataFrame:
    """``id, gx, gy, w``: the nine nodes of each point."""
    wx, wy = F.array(*lagrange(F.col("tx"))), F.array(*lagrange(F.col("ty")))
    nine = F.explode(F.expr("flatten(transform(sequence(0, 2), a -> transform(sequence(0, 2), b -> struct(a AS a, b AS b))))")).alias("k")
    rows = boxed.select("id", "ix", "iy", wx.alias("wx"), wy.alias("wy"), nine)
    return rows.select("id", (F.col("ix") * 3 + F.col("k.a")).alias("gx"), (F.col("iy") * 3 + F.col("k.b")).alias("gy"), (F.get("wx", F.col("k.a")) * F.get("wy", F.col("k.b"))).alias("w"))


def scatter(layout: DataFrame, boxes: int = N_BOXES) -> DataFrame:
    """``gx, gy, w1..w4``: charges gathered on nodes; at most the nodes of the grid are shuffled per task."""
    q = node_weights(box_index(layout, boxes)).join(layout.select("id", "x", "y"), "id")
    w = F.col("w")
    terms = (w, w * F.col("x"), w * F.col("y"), w * (F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return q.groupBy("gx", "gy").agg(*[F.sum(t).alias(f"w{k}") for k, t in enumerate(terms, 1)])


def potentials_fft(layout: DataFrame, boxes: int = N_BOXES, adaptive: bool = False) -> DataFrame:
    """``id, phi1..phi4`` by scatter, convolution of the grid in one task, and gather."""
    if adaptive:
        b = bounds(layout).first()
        boxes = smooth_boxes(b["high"] - b["low"])
    m = 3 * boxes
    grid = scatter(layout, boxes).crossJoin(F.broadcast(bounds(layout)))

    def run(table):
        w = np.zeros((4, m, m))
        gx, gy = table.column("gx").to_numpy(), table.column("gy").to_numpy()
        for k in range(4):
            w[k, gx, gy] = table.column(f"w{k + 1}").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        phi = convolve(w, box_width(low, high, boxes) / 3)[:, gx, gy]
        return pa.table({"gx": gx, "gy": gy, **{f"n{k + 1}": phi[k] for k in range(4)}})

    # the group is the grid: at most (3 * boxes)**2 rows
    nodes = grid.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, "gx int, gy int, n1 double, n2 double, n3 double, n4 double")
    at = node_weights(box_index(layout, boxes)).join(F.broadcast(nodes), ["gx", "gy"])
    return at.groupBy("id").agg(*[F.sum(F.col("w") * F.col(f"n{k}")).alias(f"phi{k}") for k in range(1, 5)])
