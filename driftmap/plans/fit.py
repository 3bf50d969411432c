"""Fits of a layout: affinities as one plan, then one of three engines for the steps.

``single_task`` runs all steps in one task, while edges and points fit there
(``SINGLE_TASK_EDGES``) and sums over all pairs are of ``EXACT_POINTS`` points at most.
``distributed`` keeps edges on the executors and
the layout, two numbers per point, on the driver, up to ``DRIVER_POINTS``
points; each step is one job, or two where sums over all pairs of more than
``EXACT_POINTS`` points are dealt out to tasks. ``dataframe`` keeps everything in tables, has no
bound, and writes the state in the shared folder after each step.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..operators import affinity, forces, integrate, knn, layout_init, linalg, nbody, symmetrize
from ..operators.distance import between, matrix
from ..options import Options
from ..scratch_tables import stored
from .loop import EXACT_POINTS, State, kept_moves, run, sums_pairs

SINGLE_TASK_EDGES = 5_000_000
DRIVER_POINTS = 10_000_000
#: Points of a group, and numbers in its features and neighbours, up to which a grouped fit takes one task for it.
GROUP_POINTS = 5_000
GROUP_VALUES = 4_000_000
#: Fits of large groups that run side by side.
GROUP_FITS = 8
#: Tasks that share sums over all pairs.
PAIR_TASKS = 48
STATE = ("id", "x", "y", "ux", "uy", "gx", "gy")
ROWS = "kind string, step int, id long, x double, y double, ux double, uy double, gx double, gy double, z double, norm double"


@dataclass
class FitResult:
    """Tables of a fit: ``layout`` (id, x, y), ``snapshots`` (snapshot, step, id, x, y), ``trajectory`` (step, id, x, y),
    ``metrics`` (step, z, update_norm) and ``state``, from which a fit can be resumed."""

    layout: DataFrame
    snapshots: DataFrame
    trajectory: DataFrame
    metrics: DataFrame
    state: DataFrame


def affinities(points: DataFrame, opt: Options, n: int | None = None) -> DataFrame:
    """Joint affinities ``i, j, p`` of ``id, features``."""
    n = points.count() if n is None else n
    k = min(opt.num_neighbors, n) - 1
    if opt.num_neighbors > n:
        warnings.warn("num_neighbors is greater than the number of points and was reduced", stacklevel=2)
    if opt.metric == "innerproduct":
        # the greatest product is the nearest; calibration needs a distance
        edges = knn.knn_exact(points, k, "innerproduct")
        top = edges.agg(F.max("d2").alias("top"))
        edges = edges.crossJoin(F.broadcast(top)).select("i", "j", (F.col("top") - F.col("d2")).alias("d2"), "rank")
    elif opt.knn == "ivf":
        edges = knn.knn_ivf(points, k, nprobe=opt.nprobe, seed=opt.random_seed + 1)
    else:
        edges = knn.knn_exact(points, k)
    edges = stored(edges, "knn")
    searched = affinity.search(edges, opt.perplexity, opt.perplexity_epsilon)
    return symmetrize.symmetrize(stored(affinity.conditional(searched), "conditional"), n, opt.symmetrize)


def first_state(points: DataFrame, opt: Options, y: DataFrame | None) -> DataFrame:
    if y is not None:
        if set(STATE) <= set(y.columns):
            return y.select(*STATE)
        return layout_init.with_state(layout_init.vector(points, y))
    draw = layout_init.uniform if opt.init == "uniform" else layout_init.gaussian
    return layout_init.with_state(draw(points, opt.random_seed))


def _rows(kind: str, step: int, ids: np.ndarray, s: State) -> pa.Table:
    n = len(ids)
    same = lambda v, t: pa.array([v] * n, t)
    return pa.table([same(kind, pa.string()), same(step, pa.int32()), pa.array(ids), *(pa.array(np.ascontiguousarray(a[:, k])) for a in (s.y, s.u, s.gain) for k in (0, 1)), same(s.z, pa.float64()), same(s.norm, pa.float64())], names=["kind", "step", *STATE, "z", "norm"])


def _loop_tables(ids: np.ndarray, state: State, attract, opt: Options, first_step: int) -> list[pa.Table]:
    out = []
    for kind, step, s in run(state, attract, opt, first_step):
        one = kind == "metric"
        out.append(_rows(kind, step, ids[:1] if one else ids, State(s.y[:1], s.u[:1], s.gain[:1], s.z, s.norm) if one else s))
    return out


def _arrays(table: pa.Table) -> tuple[np.ndarray, State]:
    table = table.sort_by("id")
    c = {name: table.column(name).to_numpy() for name in STATE}
    return c["id"], State(*(np.stack([c[a], c[b]], axis=1) for a, b in (("x", "y"), ("ux", "uy"), ("gx", "gy"))))


def _single_task(edges: DataFrame, state: DataFrame, opt: Options, first_step: int) -> DataFrame:
    def fit(edge_table, state_table):
        ids, s = _arrays(state_table)
        order = np.lexsort([edge_table.column("j").to_numpy(), edge_table.column("i").to_numpy()])
        i, j = (np.searchsorted(ids, edge_table.column(c).to_numpy()[order]) for c in "ij")
        p = edge_table.column("p").to_numpy()[order]
        attract = lambda y: kernels.attraction(y, i, j, p, len(ids))
        return pa.concat_tables(_loop_tables(ids, s, attract, opt, first_step))

    # one group by design: its size was checked against SINGLE_TASK_EDGES
    e, s = edges.withColumn("g", F.lit(0)), state.withColumn("g", F.lit(0))
    return e.groupBy("g").cogroup(s.groupBy("g")).applyInArrow(lambda a, b: fit(a.select(["i", "j", "p"]), b.select(list(STATE))), ROWS)


def _distributed(edges: DataFrame, state: DataFrame, opt: Options, first_step: int, observer: Callable | None) -> DataFrame:
    spark = edges.sparkSession
    ids, s = _arrays(state.select(*STATE).toArrow())
    # by i, so that each batch gives few sums
    packed = stored(edges.repartition("i").sortWithinPartitions("i"), "edges")
    context = spark.sparkContext
    shared_ids = context.broadcast(ids)

    def attract(y: np.ndarray) -> np.ndarray:
        shared = context.broadcast(y)

        def part(batches):
            for batch in batches:
                i, j = (np.searchsorted(shared_ids.value, batch.column(c).to_numpy()) for c in "ij")
                rows, at = np.unique(i, return_inverse=True)
                d = shared.value[i] - shared.value[j]
                d *= (batch.column("p").to_numpy() / (1 + np.square(d).sum(axis=1)))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.bincount(at, d[:, k], len(rows))) for k in (0, 1))], ["i", "fx", "fy"])

        found = packed.mapInArrow(part, "i long, fx double, fy double").toArrow()
        shared.unpersist()
        i = found.column("i").to_numpy()
        return np.stack([np.bincount(i, found.column(c).to_numpy(), len(y)) for c in ("fx", "fy")], axis=1)

    def repulse(y: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over all pairs, dealt out to tasks by rows."""
        shared = context.broadcast(y)

        def part(batches):
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    f, z = kernels.repulsion_exact(shared.value, rows=slice(len(ids) * k // PAIR_TASKS, len(ids) * (k + 1) // PAIR_TASKS))
                    yield pa.RecordBatch.from_pydict({"k": [k], "z": [z], "f": [f.tobytes()]})

        found = spark.range(0, PAIR_TASKS, 1, PAIR_TASKS).mapInArrow(part, "k long, z double, f binary").toArrow().sort_by("k")
        shared.unpersist()
        return np.concatenate([np.frombuffer(f.as_buffer()).reshape(-1, 2) for f in found.column("f")]), sum(found.column("z").to_pylist())

    parts, dealt = [], sums_pairs(opt, len(ids)) and len(ids) > EXACT_POINTS
    for kind, step, now in run(s, attract, opt, first_step, repulse if dealt else None):
        if observer and kind != "metric":
            observer(kind, step, ids, now.y)
        one = kind == "metric"
        table = _rows(kind, step, ids[:1] if one else ids, State(now.y[:1], now.u[:1], now.gain[:1], now.z, now.norm) if one else now)
        parts.append(stored(spark.createDataFrame(table, schema=T.StructType.fromDDL(ROWS)), "steps"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def one_step(edges: DataFrame, state: DataFrame, opt: Options, step: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The state after a move, and the one-row normaliser, all as tables."""
    layout = state.select("id", "x", "y")
    phi = forces.potentials_exact(layout) if exact else nbody.potentials_fft(layout, opt.n_boxes, opt.adaptive_boxes)
    rep = stored(forces.repulsion(layout, phi), "repulsion")
    z = forces.normaliser(rep)
    moved = integrate.step(state, forces.attraction(edges, layout), rep, z, opt.learning_rate, opt.exaggeration(step), opt.momentum(step))
    return stored(moved, "state"), z


def _dataframe(edges: DataFrame, state: DataFrame, opt: Options, n: int, first_step: int) -> DataFrame:
    edges, now = stored(edges, "edges"), stored(state, "state")
    exact = sums_pairs(opt, n)
    none = F.lit(None).cast("double")

    def rows(kind: str, step: int, table: DataFrame, z=none, norm=none) -> DataFrame:
        return table.select(F.lit(kind).alias("kind"), F.lit(step).cast("int").alias("step"), *STATE, z.alias("z"), norm.alias("norm"))

    step, snapshots, z, norm = first_step, kept_moves(opt), none, none
    out = [rows("snapshot", step, now)] if step in snapshots else []
    while step != opt.n_iter:
        now, z_row = one_step(edges, now, opt, step, exact)
        step += 1
        metric = opt.verbose and (step - 1) % opt.print_interval == 0
        if opt.min_grad_norm > 0 or metric or step == opt.n_iter:
            z, length = F.lit(z_row.first()["z"]), linalg.l2_norm(now, "ux", "uy").first()["norm"]
            norm = F.lit(length)
            if opt.min_grad_norm > 0 and length < opt.min_grad_norm:
                break
            if metric:
                out.append(rows("metric", step, now.orderBy("id").limit(1), z, norm))
        if step in snapshots and step != opt.n_iter:
            out.append(rows("snapshot", step, now))
        if opt.dump_points and (step - 1) % opt.dump_interval == 0:
            out.append(rows("dump", step, now))
    result = rows("final", step, now, z, norm)
    for part in out:
        result = result.unionByName(part)
    return result


def fit(points: DataFrame, opt: Options, y: DataFrame | None = None, first_step: int = 0, edges: DataFrame | None = None, observer: Callable | None = None) -> FitResult:
    """Fit a layout of ``id, features``.

    ``y`` is a first layout (``id, x, y``), or the state of an earlier fit, which
    then goes on at ``first_step``. ``edges`` are given joint affinities.
    ``observer(kind, step, ids, layout)`` is called per kept step by the
    distributed engine.
    """
    opt.validate()
    n = points.count()
    if n < 2:
        raise ValueError("a fit needs two points at least")
    edges = affinities(points, opt, n) if edges is None else edges
    edges = stored(edges, "joint")
    state = first_state(points.select("id"), opt, y)
    engine = opt.engine
    if engine in ("auto", "single_task"):
        fits = n <= SINGLE_TASK_EDGES and not (sums_pairs(opt, n) and n > EXACT_POINTS) and edges.count() <= SINGLE_TASK_EDGES
        if not fits and engine == "single_task":
            warnings.warn("the fit is too large for one task; another engine gives the same layout", stacklevel=2)
        engine = "single_task" if fits else "distributed" if n <= DRIVER_POINTS else "dataframe"
    if engine == "single_task":
        found = _single_task(edges, state, opt, first_step)
    elif engine == "distributed":
        found = _distributed(edges, state, opt, first_step, observer)
    else:
        found = _dataframe(edges, state, opt, n, first_step)
    return _result(stored(found, "fit"), opt)


def _result(found: DataFrame, opt: Options) -> FitResult:
    final = found.where("kind = 'final'")
    shown = found.where("kind IN ('snapshot', 'final')")
    steps = sorted(r["step"] for r in shown.select("step").distinct().collect())
    number = F.create_map(*[F.lit(v) for k, s in enumerate(steps) for v in (s, k)])
    snapshots = shown.select(F.element_at(number, F.col("step")).alias("snapshot"), "step", "id", "x", "y")
    metrics = found.where("kind IN ('metric', 'final')").groupBy("step").agg(F.first("z").alias("z"), F.first("norm").alias("update_norm"))
    return FitResult(final.select("id", "x", "y"), snapshots, found.where("kind = 'dump'").select("step", "id", "x", "y"), metrics, final.select(*STATE))


def nearest_rows(x: np.ndarray, k: int, metric: str = "sqeuclidean", cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of every row of x, ``(j, d2)``; ties to the earlier row.

    Rows are taken so many at a time that ``cells`` distances are held. For
    products, ``d2`` is how far each falls short of the greatest one.
    """
    n = len(x)
    near, d2 = np.empty((n, k), np.int64), np.empty((n, k))
    step = max(1, cells // n)
    for lo in range(0, n, step):
        d = between(x[lo : lo + step], x, metric)
        d = -d if metric == "innerproduct" else d
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near[lo : lo + step] = np.argsort(d, axis=1, kind="stable")[:, :k]
        d2[lo : lo + step] = np.take_along_axis(d, near[lo : lo + step], axis=1)
    return near, d2 - d2.min() if metric == "innerproduct" else d2


def joint_edges(near: np.ndarray, p: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint affinities ``i, j, p`` of the conditional ones of neighbours, ordered by i and j."""
    n, k = near.shape
    i, j, p = np.repeat(np.arange(n), k), near.ravel(), p.ravel()
    forth, back = i * n + j, j * n + i
    keys, at = np.unique(np.concatenate([forth, back]), return_inverse=True)
    joint = np.bincount(at, np.concatenate([p, p]), len(keys)) / (2 * n)
    if mode == "one_sided":
        kept = np.unique(at[: len(forth)])
        keys, joint = keys[kept], joint[kept]
    return keys // n, keys % n, joint


def fit_groups(points: DataFrame, opt: Options, group_col: str = "group") -> DataFrame:
    """Independent fits: ``group, id, x, y`` of ``group, id, features``.

    Groups are counted first. One of up to ``GROUP_POINTS`` points and
    ``GROUP_VALUES`` numbers is fitted in a task, where the search for
    neighbours is always exact; larger ones go through ``fit``, whose engines
    have no such bound, ``GROUP_FITS`` at a time. Groups of one point stay at the origin.
    """
    opt = replace(opt.validate(), return_style="once", dump_points=False, verbose=0)
    dtype = points.schema[group_col].dataType.simpleString()
    metric = "innerproduct" if opt.metric == "innerproduct" else "sqeuclidean"

    def one(key, table):
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), matrix(table.column("features").combine_chunks())
        n = len(ids)
        if n < 2:
            y = np.zeros((n, 2))
        else:
            near, d2 = nearest_rows(x, min(opt.num_neighbors, n) - 1, metric)
            p = kernels.calibrate(d2 / (d2.max() or 1.0), opt.perplexity, opt.perplexity_epsilon)["p"]
            i, j, joint = joint_edges(near, p, opt.symmetrize)
            draw = np.random.default_rng(opt.random_seed)
            first = draw.uniform(-5, 5, (n, 2)) if opt.init == "uniform" else draw.normal(0, 1e-4, (n, 2))
            state = State(first, np.zeros((n, 2)), np.ones((n, 2)))
            attract = lambda y: kernels.attraction(y, i, j, joint, n)
            for _, _, last in run(state, attract, opt):
                y = last.y
        return pa.table({"group": pa.array([key[0].as_py()] * n, table.column("group").type), "id": ids, "x": y[:, 0], "y": y[:, 1]})

    rows = points.select(F.col(group_col).alias("group"), F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features"))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width"))
    beyond = (F.col("n") > GROUP_POINTS) | (F.col("n") * (F.col("width") + F.least("n", F.lit(opt.num_neighbors))) > GROUP_VALUES)
    large = stored(sizes.where(beyond).select(F.col("group").alias("g"), F.monotonically_increasing_id().alias("k")), "large-groups")
    numbers = [r["k"] for r in large.select("k").collect()]
    same = F.col("group").eqNullSafe(F.col("g"))
    small = rows.join(F.broadcast(large), same, "left_anti") if numbers else rows
    out = small.groupBy("group").applyInArrow(one, f"group {dtype}, id long, x double, y double")
    if numbers:
        apart = stored(rows.join(F.broadcast(large), same).select("k", "id", "features"), "large-points")
        with ThreadPoolExecutor(GROUP_FITS) as pool:
            layouts = list(pool.map(lambda k: fit(apart.where(F.col("k") == k).select("id", "features"), opt).layout, numbers))
        for k, layout in zip(numbers, layouts):
            named = F.broadcast(large.where(F.col("k") == k).select(F.col("g").alias("group")))
            out = out.unionByName(layout.crossJoin(named).select("group", "id", "x", "y"))
    return out
