"""All-pairs work: what is moved and sent grows no faster than the points, and ties are whole."""

import threading

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from driftmap import Options, fit, fit_groups, queries
from driftmap.functions import kernels
from driftmap.operators import distance, forces, knn, quality, symmetrize
from driftmap.plans import fit as plan
from driftmap.plans import loop


def points_of(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, features array<double>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_sent_to_a_fixed_number_of_parts(spark):
    rows = lambda n, width=1: spark.range(n).select("id", F.array_repeat(F.lit(0.0), width).alias("features"))
    assert [distance.parts_of(rows(n), distance.BLOCK) for n in (100, 10_000, 100_000, 0)] == [1, distance.PARTS, distance.PARTS, 1]
    # a part of wide points stays small enough for a task
    assert distance.parts_of(rows(50_000, 4_000), distance.BLOCK) > distance.PARTS


def test_pairs_and_neighbours_join_nothing(spark):
    p = points_of(spark, np.random.default_rng(1).random((60, 3)))
    for df in (distance.pairwise(p, block=7), knn.knn_exact(p, 5, block=7), forces.potentials_exact(p.select("id", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y")), block=7)):
        plan = plan_of(df)
        assert "Join" not in plan and plan.count("Exchange") == 1, plan
    assert distance.pairwise(p, block=7).select("i", "j").distinct().count() == 3600


def test_ties_beyond_any_reserve_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.integers(0, 3, (4, 5)), 60, axis=0), rng.integers(0, 3, (60, 5))]).astype(float)
    ids = rng.permutation(1000)[: len(x)]
    for metric, key in (("sqeuclidean", lambda q: np.square(x - x[q]).sum(axis=1)), ("innerproduct", lambda q: -(x @ x[q]))):
        for with_self in (False, True):
            want = []
            for q in range(len(x)):
                order = [j for j in np.lexsort((ids, key(q))) if with_self or j != q][:6]
                want += [(ids[q], rank + 1, ids[j], abs(key(q)[j])) for rank, j in enumerate(order)]
            got = knn.knn_exact(points_of(spark, x, ids), 6, metric, with_self, block=50)
            assert sorted((r.i, r["rank"], r.j, r.d2) for r in got.collect()) == sorted(want)


def test_neighbours_far_from_the_origin_and_of_huge_values():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(300, 8)) + 1e6, rng.normal(size=(300, 8)) * 1e20):
        best = knn.Nearest(np.arange(300), x, 5, "sqeuclidean", False)
        for lo in range(0, 300, 64):
            best.meet(np.arange(lo, min(300, lo + 64)), x[lo : lo + 64])
        d = np.square(x[:, None] - x[None]).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        best._merge()
        assert (best.j == np.argsort(d, axis=1)[:, :5]).all()


def test_ranks_of_layout_neighbours_join_no_distances(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 3, (90, 3)).astype(float), np.zeros((40, 3)), rng.normal(size=(70, 3)) * 50])
    ids = rng.permutation(500)[: len(x)]
    p, y = points_of(spark, x, ids), rng.normal(size=(len(x), 2))
    d, near = np.square(x[:, None] - x[None]).sum(axis=2), np.square(y[:, None] - y[None]).sum(axis=2)
    rank, want = {}, []
    for q in range(len(x)):
        order = [j for j in np.lexsort((ids, d[q])) if j != q]
        rank |= {(ids[q], ids[j]): r + 1 for r, j in enumerate(order)}
        want += [(ids[q], ids[j]) for j in [j for j in np.lexsort((ids, near[q])) if j != q][:6]]
    pairs = spark.createDataFrame([(int(i), int(j)) for i, j in want], "i long, j long")
    got = quality.neighbor_ranks(p, pairs, block=64)
    assert {(r.i, r.j): r.r for r in got.collect()} == {ij: rank[ij] for ij in want}
    layout = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, y)], "id long, x double, y double")
    n, trust = len(x), quality.trustworthiness(p, layout, 6)
    # distances of all pairs meet nothing: the only join gives points their targets
    assert plan_of(trust).count("mapInArrow") + plan_of(trust).count("MapInArrow") <= 2
    assert abs(trust.first().trust - (1 - 2 / (n * 6 * (2 * n - 19)) * sum(max(0, rank[ij] - 6) for ij in want))) < 1e-12


def test_pair_sums_of_rows_are_those_of_the_whole():
    y = np.random.default_rng(6).normal(0, 3, (700, 2)) + 50
    whole, z = kernels.repulsion_exact(y, cells=1 << 10, columns=64)
    d = y[:, None] - y[None]
    w = 1 / (1 + np.square(d).sum(axis=2))
    assert np.allclose(whole, (d * np.square(w)[:, :, None]).sum(axis=1)) and z == pytest.approx(w.sum() - 700)
    parts = [kernels.repulsion_exact(y, rows=slice(a, a + 100)) for a in range(0, 700, 100)]
    assert np.allclose(np.concatenate([f for f, _ in parts]), whole) and sum(v for _, v in parts) == pytest.approx(z)


def test_pair_sums_too_large_for_a_task_are_dealt_out(spark, monkeypatch):
    p = points_of(spark, np.random.default_rng(7).normal(size=(90, 4)))
    go = lambda engine: np.array(fit(p, Options(perplexity=5, num_neighbors=16, n_iter=3, engine=engine, repulsion="exact", random_seed=4)).layout.orderBy("id").select("x", "y").collect())
    want = go("single_task")

    def refuse(*_, **__):
        raise AssertionError("all pairs in one place")

    monkeypatch.setattr(plan, "EXACT_POINTS", 50)
    monkeypatch.setattr(loop, "repel", refuse)
    monkeypatch.setattr(plan, "_single_task", refuse)
    with pytest.warns(UserWarning, match="too large for one task"):
        assert np.abs(go("single_task") - want).max() < 1e-9
    for engine in ("distributed", "auto"):
        assert np.abs(go(engine) - want).max() < 1e-9


def test_large_groups_are_fitted_side_by_side(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(80, 4))
    rows = points_of(spark, x).select((F.col("id") % 2).alias("group"), "id", "features")
    opt, both, whole = Options(perplexity=5, num_neighbors=16, n_iter=3), threading.Barrier(2, timeout=60), plan.fit
    monkeypatch.setattr(plan, "GROUP_POINTS", 30)
    monkeypatch.setattr(plan, "fit", lambda *a, **k: (both.wait(), whole(*a, **k))[1])
    got = {r.id: (r.group, r.x, r.y) for r in fit_groups(rows, opt).collect()}
    for g in (0, 1):
        want = whole(rows.where(F.col("group") == g).select("id", "features"), opt).layout.collect()
        assert len(want) == 40 and all(got[r.id][0] == g and np.allclose(got[r.id][1:], (r.x, r.y)) for r in want)


def test_edges_meet_their_mirrors_without_a_join(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (2, 1, 1.0)], "i long, j long, p double")
    one = symmetrize.one_sided(e, 3)
    assert "Join" not in plan_of(one)
    assert {(r.i, r.j): r.p for r in one.collect()} == pytest.approx({(0, 1): 0.25, (1, 0): 0.25, (2, 1): 1 / 6})


@pytest.mark.parametrize("name", ["integrate_step", "update_norm"])
def test_a_step_sums_over_all_pairs_once(spark, name):
    assert "MapInArrow" not in plan_of(queries.QUERIES[name](spark, SMALL))
