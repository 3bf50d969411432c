"""Conditional affinities of neighbours.

Rows are independent, so the search for each row's precision is one pass over
packed rows, whatever the number of bisection rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import calibrate
from ..functions.scalar import entropy_term, gaussian
from .linalg import max_normalize

PACKED = "i long, js array<long>, ps array<double>, beta double, entropy double, met boolean, rounds int"


def pack_neighbors(knn: DataFrame) -> DataFrame:
    """``i, js, ds`` by ascending distance."""
    cells = F.array_sort(F.collect_list(F.struct("d2", "j")))
    return knn.groupBy("i").agg(cells.alias("c")).select("i", F.transform("c", lambda c: c["j"]).alias("js"), F.transform("c", lambda c: c["d2"]).alias("ds"))


def search(knn: DataFrame, perplexity: float, epsilon: float = 1e-3, rounds: int = 200, normalize: bool = True) -> DataFrame:
    """Packed rows with calibrated affinities: ``i, js, ps, beta, entropy, met, rounds``.

    Distances are first divided by their greatest value. A row whose
    perplexity is out of reach keeps its last affinities, with ``met`` false.
    """
    packed = pack_neighbors(max_normalize(knn, "d2") if normalize else knn)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lengths = np.diff(batch.column("ds").offsets.to_numpy())
            valid = np.arange(lengths.max()) < lengths[:, None]
            d = np.zeros(valid.shape)
            d[valid] = batch.column("ds").flatten().to_numpy()
            found = calibrate(d, perplexity, epsilon, rounds, valid)
            ps = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(found["p"][valid]))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(batch.column("js").to_pylist(), pa.list_(pa.int64())), ps, *(pa.array(found[c]) for c in ("beta", "entropy", "met", "rounds"))], ["i", "js", "ps", "beta", "entropy", "met", "rounds"])

    return packed.mapInArrow(run, PACKED)


def all_met(searched: DataFrame) -> DataFrame:
    """One row: did every point reach its perplexity?"""
    return searched.agg(F.coalesce(F.bool_and("met"), F.lit(True)).alias("met"))


def conditional(searched: DataFrame) -> DataFrame:
    """Edges ``i, j, p`` of packed rows."""
    return searched.select("i", F.explode(F.arrays_zip("js", "ps")).alias("c")).select("i", F.col("c.js").alias("j"), F.col("c.ps").alias("p"))


def at_fixed_beta(knn: DataFrame, beta: float, normalize: bool = True) -> DataFrame:
    """``i, j, p``: normalised Gaussian affinities at one precision for all rows."""
    edges = max_normalize(knn, "d2") if normalize else knn
    edges = edges.select("i", "j", gaussian(F.col("d2"), F.lit(beta)).alias("k"))
    total = edges.groupBy("i").agg(F.sum("k").alias("s"))
    return edges.join(total, "i").select("i", "j", (F.col("k") / F.col("s")).alias("p"))


def row_entropy(edges: DataFrame) -> DataFrame:
    """``i, entropy`` of the affinities of each row."""
    return edges.groupBy("i").agg((-F.sum(entropy_term(F.col("p")))).alias("entropy"))
