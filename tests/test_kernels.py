import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmap.functions import kernels as k


def test_equal_distances_cannot_reach_a_higher_perplexity():
    out = k.calibrate(np.full((3, 7), 0.5), 50.0, 1e-3)
    assert not out["met"].any()
    assert np.allclose(out["entropy"], np.log(7)) and np.allclose(out["p"], 1 / 7)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(12, 40))
def test_calibrated_rows_meet_the_perplexity(seed, width):
    d = np.random.default_rng(seed).random((5, width))
    out = k.calibrate(d, 5.0, 1e-4)
    assert out["met"].all() and np.allclose(out["p"].sum(axis=1), 1)
    h = -(out["p"] * np.log(out["p"], where=out["p"] > 0, out=np.zeros_like(d))).sum(axis=1)
    assert np.abs(h - np.log(5)).max() < 2e-4


def test_two_points():
    y = np.array([[0.0, 0.0], [1.0, 0.0]])
    rep, z = k.repulsion_exact(y)
    assert z == pytest.approx(1) and np.allclose(rep, [[-0.25, 0], [0.25, 0]])
    attr = k.attraction(y, np.array([0, 1]), np.array([1, 0]), np.array([0.5, 0.5]), 2)
    assert np.allclose(attr, [[-0.25, 0], [0.25, 0]])


def test_step_by_hand():
    one = lambda v: np.array([[v, v]])
    y, u, gain = k.integrate(one(0.0), one(0.0), one(1.0), one(0.5), one(0.2), 2.0, 200.0, 12.0, 0.5)
    assert np.allclose(gain, 0.8) and np.allclose(u, -944) and np.allclose(y, -944)
    _, u, gain = k.integrate(one(0.0), one(0.0), one(1.0), one(-0.1), one(0.0), 1.0, 200.0, 1.0, 0.5)
    assert np.allclose(gain, 1.2) and np.allclose(u, 24)
    assert np.allclose(k.integrate(one(0.0), one(1.0), one(0.012), one(0.1), one(0.0), 1.0, 1.0, 1.0, 0.5)[2], 0.01)


def test_lagrange():
    assert np.allclose(k.lagrange(np.array([0.5, 0.0])), [[0, 1, 0], [1.875, -1.25, 0.375]])


@pytest.mark.parametrize(("spread", "error"), [(1e-4, 1e-6), (1.0, 1e-4), (5.0, 2e-3)])
def test_grid_agrees_with_pair_sums(spread, error):
    y = np.random.default_rng(1).normal(0, spread, (800, 2))
    exact, z = k.repulsion_exact(y)
    grid, zg = k.repulsion_fft(y)
    assert zg == pytest.approx(z, rel=error)
    assert np.linalg.norm(grid - exact) / np.linalg.norm(exact) < error
    assert np.abs(exact.sum(axis=0)).max() < 1e-6 * len(y)


def test_grid_with_one_place_and_with_adaptive_boxes():
    rep, z = k.repulsion_fft(np.zeros((5, 2)))
    assert np.isfinite(rep).all() and z == pytest.approx(20, rel=1e-3)
    wide = np.random.default_rng(2).normal(0, 20, (500, 2))
    exact = k.repulsion_exact(wide)[0]
    error = lambda got: np.linalg.norm(got - exact) / np.linalg.norm(exact)
    assert error(k.repulsion_fft(wide, adaptive=True)[0]) < error(k.repulsion_fft(wide)[0])
    assert (k.smooth_boxes(10), k.smooth_boxes(26), k.smooth_boxes(1e9)) == (36, 54, 400)
