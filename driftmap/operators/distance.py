"""Distances between all points, in pieces.

Points are dealt into parts of bounded size by a hash. A task holds one part and
meets all points, piece by piece, as they stream past, and works with matrix
products. The number of parts is fixed until a part would be too large for a
task, so what is shuffled grows as the points do, though the work is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Parts of a sweep (fewer for few points), and the most bytes of a part's features and results, beyond which there are more parts.
PARTS = 24
PART_BYTES = 1 << 26
METRICS = ("sqeuclidean", "euclidean", "innerproduct", "manhattan", "chebyshev", "canberra", "braycurtis", "jensenshannon")


def matrix(features: pa.Array) -> np.ndarray:
    """A dense matrix of a list column whose rows have one length."""
    flat = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(features), -1)


def between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The matrix of distances (or products) of the rows of a and b."""
    if metric == "innerproduct":
        return a @ b.T
    if metric in ("sqeuclidean", "euclidean"):
        d = np.abs(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T))
        return d if metric == "sqeuclidean" else np.sqrt(d)
    out = np.empty((len(a), len(b)))
    for k, row in enumerate(a):
        gap, plus = np.abs(row - b), np.abs(row) + np.abs(b)
        if metric == "manhattan":
            out[k] = gap.sum(axis=1)
        elif metric == "chebyshev":
            out[k] = gap.max(axis=1)
        elif metric == "canberra":
            out[k] = np.divide(gap, plus, out=np.zeros_like(gap), where=plus > 0).sum(axis=1)
        elif metric == "braycurtis":
            total = np.abs(row + b).sum(axis=1)
            out[k] = np.divide(gap.sum(axis=1), total, out=np.zeros(len(b)), where=total > 0)
        elif metric == "jensenshannon":
            x, y = row / row.sum(), b / b.sum(axis=1, keepdims=True)
            m = (x + y) / 2
            term = lambda p: np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0)
            out[k] = np.sqrt(np.maximum(0, (term(np.broadcast_to(x, y.shape)) + term(y)).sum(axis=1) / 2))
        else:
            raise ValueError(f"metric must be one of {METRICS}")
    return out


def _deal(carried: list[str], rows: int) -> Callable:
    """Pieces of the rows: those that a part owns with what they carry, and all of them for every part (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, part = batch.column("id").to_numpy(), matrix(batch.column("features")), batch.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1), len(order)]
            pieces = [(int(part[at[0]]), at) for at in (order[a:b] for a, b in zip(cuts, cuts[1:]))]
            pieces += [(-1, np.arange(lo, min(lo + rows, len(ids)))) for lo in range(0, len(ids), rows)]
            for owner, at in pieces:
                extra = pa.BufferOutputStream()
                if owner >= 0 and carried:
                    with pa.ipc.new_stream(extra, batch.select(carried).schema) as sink:
                        sink.write_batch(batch.select(carried).take(pa.array(at)))
                yield pa.RecordBatch.from_pydict({"part": [owner], "ids": [ids[at].tobytes()], "x": [x[at].tobytes()], "carried": [extra.getvalue().to_pybytes()]}, schema=pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("carried", pa.binary())]))

    return run


def parts_of(points: DataFrame, block: int) -> int:
    """How many parts a sweep takes."""
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    most = max(1, PART_BYTES // (8 * (width or 0) + 512))
    return max(1, -(-n // most), min(PARTS, -(-n // min(block, 256))))


def sweep(points: DataFrame, start: Callable, schema: str, block: int = BLOCK, carried: tuple[str, ...] = ()) -> DataFrame:
    """Let every part of the points meet all points, a piece of at most ``block`` rows at a time.

    ``start(ids, a, carried)`` gets the rows of a part, with a table of their
    ``carried`` columns, and returns ``meet(ids, b)`` and ``finish()``, which yield
    record batches of ``schema``.
    """
    parts = parts_of(points, block)
    kept = points.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features"), *carried, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    dealt = kept.mapInArrow(_deal(list(carried), block), "part int, ids binary, x binary, carried binary")
    everywhere = F.explode(F.when(F.col("part") < 0, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("part"))).alias("at")
    met = dealt.select(everywhere, (F.col("part") < 0).alias("all"), "ids", "x", "carried").repartitionById(parts, "at").sortWithinPartitions("all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, meet, finish = [], None, None
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), np.int64)
                x = np.frombuffer(batch.column("x")[k].as_buffer()).reshape(len(ids), -1)
                if not batch.column("all")[k].as_py():
                    own.append((ids.copy(), x.copy(), batch.column("carried")[k].as_py()))
                elif own:
                    if meet is None:
                        tables = [pa.ipc.open_stream(c).read_all() for *_, c in own] if carried else []
                        meet, finish = start(np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]), pa.concat_tables(tables) if tables else None)
                    yield from meet(ids, x)
        if finish is not None:
            yield from finish()

    return met.select("all", "ids", "x", "carried").mapInArrow(run, schema)


def pairwise(points: DataFrame, metric: str = "sqeuclidean", block: int = BLOCK) -> DataFrame:
    """``i, j, d`` for every ordered pair of points, a point with itself included."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    def start(ids_a, a, _):
        def meet(ids_b, b):
            rows = max(1, (1 << 20) // max(1, len(ids_b)))
            for lo in range(0, len(ids_a), rows):
                part = ids_a[lo : lo + rows]
                d = between(a[lo : lo + rows], b, metric)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(ids_b))), pa.array(np.tile(ids_b, len(part))), pa.array(d.ravel())], ["i", "j", "d"])

        return meet, tuple

    return sweep(points, start, "i long, j long, d double", block)
