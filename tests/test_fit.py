import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap import TSNE, Options, fit, fit_groups
from driftmap.operators import forces, knn, nbody, quality
from driftmap.plans import fit as plan
from driftmap.plans import sweep
from driftmap.sources import files, generate, trajectory, vectors
from driftmap.streaming import observer


@pytest.fixture(scope="module")
def blobs(spark):
    return generate.two_blobs(spark, 120, 10, seed=2).cache()


def test_options():
    with pytest.raises(NotImplementedError):
        Options(n_components=3).validate()
    for wrong in ({"metric": "cosine"}, {"init": "pca"}, {"return_style": "all"}, {"return_style": "snapshots", "num_snapshots": 1}, {"n_iter": -1}, {"return_style": "snapshots", "n_iter": 2}):
        with pytest.raises(ValueError):
            Options(perplexity=5, **wrong).validate()
    with pytest.warns(UserWarning, match="out of reach"):
        Options().validate()
    o = Options(perplexity=5)
    assert (o.exaggeration(249), o.exaggeration(250), o.momentum(249), o.momentum(250)) == (12.0, 1.0, 0.5, 0.8)
    compat = lambda t, s: len(Options(n_iter=t, num_snapshots=s, return_style="snapshots", snapshot_compat=True).snapshot_steps())
    assert [compat(1000, 5), compat(1000, 4), compat(999, 5)] == [5, 5, 6]


def test_engines_agree(spark, blobs):
    out = {}
    for engine in ("single_task", "distributed", "dataframe"):
        opt = Options(perplexity=5, n_iter=6, engine=engine, random_seed=4, verbose=1, print_interval=1)
        res = fit(blobs, opt)
        out[engine] = res.layout.orderBy("id").toPandas()[["x", "y"]].values
        assert res.metrics.count() == 6 and res.metrics.where("z IS NULL").count() == 0
    assert np.abs(out["single_task"] - out["distributed"]).max() < 1e-9
    assert np.abs(out["single_task"] - out["dataframe"]).max() < 1e-9


def test_a_fit_parts_the_blobs(spark, blobs):
    layout = TSNE(perplexity=10, n_iter=400, random_seed=1).fit_transform(blobs)
    near = knn.knn_exact(layout.select("id", F.array("x", "y").alias("features")), 5)
    assert quality.label_purity(near, blobs.select("id", "label")).first().purity > 0.95


def test_divergence_falls(spark, blobs):
    from driftmap import affinities

    opt = Options(perplexity=10, n_iter=400, symmetrize="full")
    edges = affinities(blobs, opt).cache()

    def kl(steps):
        at = fit(blobs, Options(perplexity=10, n_iter=steps), edges=edges).layout
        return forces.kl_divergence(edges, at, forces.normaliser(forces.repulsion(at, forces.potentials_exact(at)))).first().kl

    assert kl(400) < kl(0)


def test_snapshots_dump_stop_and_resume(spark, blobs, tmp_path):
    opt = Options(perplexity=5, n_iter=20, return_style="snapshots", num_snapshots=5, dump_points=True, dump_interval=5, random_seed=4)
    res = fit(blobs, opt)
    assert [r.step for r in res.snapshots.select("step").distinct().orderBy("step").collect()] == [0, 5, 10, 15, 20]
    assert [r.step for r in res.trajectory.select("step").distinct().orderBy("step").collect()] == [1, 6, 11, 16]
    trajectory.write_text(res.trajectory, f"{tmp_path}/dump")
    back = trajectory.read_text(spark, f"{tmp_path}/dump").orderBy("frame", "idx").toPandas()
    want = res.trajectory.orderBy("step", "id").toPandas()
    assert np.array_equal(back[["x", "y"]].values, want[["x", "y"]].values)

    half = fit(blobs, Options(perplexity=5, n_iter=10, random_seed=4))
    rest = fit(blobs, Options(perplexity=5, n_iter=20, random_seed=4), y=half.state, first_step=10)
    a, b = (d.orderBy("id").toPandas()[["x", "y"]].values for d in (rest.layout, res.layout))
    assert np.abs(a - b).max() < 1e-9

    stopped = fit(blobs, Options(perplexity=5, n_iter=-1, min_grad_norm=1e9))
    assert stopped.metrics.first().step == 1


def test_observer_and_stream(spark, blobs, tmp_path):
    folder = f"{tmp_path}/steps"
    opt = Options(perplexity=5, n_iter=4, engine="distributed", dump_points=True)
    fit(blobs, opt, observer=observer.FolderPublisher(spark, folder))
    got = observer.run_to_end(observer.step_summary(observer.watch(spark, folder))).orderBy("step").collect()
    assert [(r.step, r.n) for r in got][:4] == [(1, 120), (2, 120), (3, 120), (4, 240)]


def test_groups_metrics_and_clamp(spark, blobs):
    g = fit_groups(blobs.withColumnRenamed("label", "group"), Options(perplexity=5, num_neighbors=16, n_iter=30))
    assert g.groupBy("group").count().count() == 2 and g.count() == 120
    with pytest.warns(UserWarning, match="reduced"):
        few = fit(blobs.limit(10), Options(perplexity=3, n_iter=5, metric="innerproduct"))
    assert few.layout.count() == 10
    with pytest.raises(ValueError):
        fit(blobs.limit(1), Options(perplexity=3))
    ivf = fit(blobs, Options(perplexity=5, n_iter=5, knn="ivf", repulsion="fft"))
    assert ivf.layout.where("isnan(x)").count() == 0
    assert quality.trustworthiness(blobs, ivf.layout, 5).first().trust <= 1
    assert nbody.bounds(ivf.layout).count() == 1


def test_groups_too_large_for_a_task_are_fitted_whole(spark, blobs, monkeypatch):
    monkeypatch.setattr(plan, "GROUP_POINTS", 30)
    rows = blobs.select(F.when(F.col("id") % 4 > 0, 1).alias("group"), "id", "features")
    opt = Options(perplexity=5, num_neighbors=16, n_iter=10)
    got = {(r.group, r.id): (r.x, r.y) for r in fit_groups(rows, opt).collect()}
    assert set(got) == {(r.group, r.id) for r in rows.collect()}
    whole = fit(rows.where("group = 1").select("id", "features"), opt).layout.collect()
    assert len(whole) == 90 and all(np.allclose(got[1, r.id], (r.x, r.y)) for r in whole)


def test_groups_honour_metric_and_init(spark, blobs):
    rows = blobs.select(F.lit("a").alias("group"), "id", "features")
    layout = lambda **o: np.array(fit_groups(rows, Options(perplexity=5, num_neighbors=16, n_iter=o.pop("n_iter", 20), **o)).orderBy("id").select("x", "y").collect())
    assert not np.allclose(layout(), layout(metric="innerproduct"))
    assert np.abs(layout(n_iter=0, init="uniform")).max() > 1


def test_neighbours_of_a_group_hold_no_square():
    x = np.random.default_rng(1).normal(size=(3000, 4))
    tracemalloc.start()
    near, d2 = plan.nearest_rows(x, 5, cells=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    d = np.square(x[:, None] - x[None]).sum(axis=2) + np.diag(np.full(3000, np.inf))
    assert (near == np.argsort(d, axis=1)[:, :5]).all() and np.allclose(d2, np.sort(d, axis=1)[:, :5])
    p = np.random.default_rng(2).random((3000, 5))
    dense = np.zeros((3000, 3000))
    dense[np.arange(3000)[:, None], near] = p
    joint = (dense + dense.T) / 6000
    for mode, where in (("full", joint > 0), ("one_sided", dense > 0)):
        i, j, got = plan.joint_edges(near, p, mode)
        assert (np.stack([i, j]) == np.nonzero(where)).all() and np.allclose(got, joint[i, j])


def test_vectors(spark):
    df = spark.createDataFrame([(1, 2.0, 3, [[1.0], [2.0]]), (2, 5.0, 6, [[3.0], [4.0]])], "k int, a double, b int, m array<array<double>>")
    assert vectors.vectorise(df, "k", ["a", "b"]).orderBy("id").first().features == [2.0, 3.0]
    assert vectors.vectorise(df, "k", "m").orderBy("id").first().features == [1.0, 2.0]
    with pytest.raises(Exception, match="finite"):
        vectors.vectorise(spark.createDataFrame([(1, [float("nan")])], "id int, features array<double>")).collect()
    assert vectors.from_numpy(spark, np.arange(12).reshape(2, 2, 3)).count() == 2


def test_files(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (5, 2, 3), np.uint8)
    (tmp_path / "img").write_bytes(np.array([2051, 5, 2, 3], ">i4").tobytes() + pixels.tobytes())
    got = files.idx_images(spark, str(tmp_path / "img")).orderBy("id").toPandas()
    assert np.allclose(np.stack(got.features), pixels.reshape(5, 6) / 255)
    (tmp_path / "lab").write_bytes(np.array([2049, 5], ">i4").tobytes() + bytes([3, 1, 4, 1, 5]))
    assert [r.label for r in files.idx_labels(spark, str(tmp_path / "lab")).orderBy("id").collect()] == [3, 1, 4, 1, 5]
    for k in (1, 2):
        record = np.random.default_rng(k).integers(0, 256, (4, k + 3072), np.uint8)
        (tmp_path / f"c{k}").mkdir()
        for part in range(2):
            (tmp_path / f"c{k}" / f"batch_{part}.bin").write_bytes(record.tobytes())
        c = files.cifar(spark, str(tmp_path / f"c{k}"), k).orderBy("id").toPandas()
        assert c.id.tolist() == list(range(8)) and c.label.tolist() == record[:, k - 1].tolist() * 2
        assert np.allclose(c.features[0], record[0, k:] / 255)
    np.savez(tmp_path / "x.npz", other=np.zeros(2), x_train=np.arange(12).reshape(4, 3))
    assert files.npz(spark, str(tmp_path / "x.npz"), n=3).count() == 3


def test_sweep(spark):
    runs = sweep.time_runs(spark, ["a", "b"], lambda c: sum(range(1000)), repeats=2)
    assert runs.count() == 4 and sweep.fastest(sweep.summarise(runs)).count() == 1
    assert generate.rings(spark, 50).count() == generate.uniform(spark, 50, 3).count() == 50
