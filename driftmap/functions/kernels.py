"""Array kernels that run inside tasks: calibration, forces, grid convolution, integration."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Interpolation nodes of a box, in box widths.
NODES = np.array([1 / 6, 1 / 2, 5 / 6])
#: Default boxes per dimension.
N_BOXES = 130
#: Box width of a layout whose points are all in one place.
ONE_PLACE = 0.01


def calibrate(d2: np.ndarray, perplexity: float, epsilon: float, rounds: int = 200, valid: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Bisect the precision of every row of neighbour distances until its entropy meets ln(perplexity).

    Rows are independent; one that is met keeps its precision. A row that is
    not met after ``rounds`` keeps the affinities of its last evaluation.
    """
    n = len(d2)
    valid = np.ones(d2.shape, bool) if valid is None else valid
    beta, low, high = np.ones(n), np.full(n, -np.inf), np.full(n, np.inf)
    met, used, entropy, spent = np.zeros(n, bool), np.ones(n), np.zeros(n), np.zeros(n, np.int32)
    p = np.zeros(d2.shape)
    open_rows = np.arange(n)
    target = np.log(perplexity)
    for _ in range(rounds):
        if not len(open_rows):
            break
        with np.errstate(under="ignore"):
            k = np.exp(-beta[open_rows, None] * d2[open_rows]) * valid[open_rows]
        total = k.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = -np.where(k > 0, k * np.log(k), 0).sum(axis=1) / total + np.log(total)
            p[open_rows] = k / total[:, None]
        used[open_rows], entropy[open_rows] = beta[open_rows], h
        spent[open_rows] += 1
        gap = h - target
        done = np.abs(gap) < epsilon
        met[open_rows[done]] = True
        wide = gap > 0  # false for an undefined entropy, which widens the kernel
        r = open_rows[wide & ~done]
        low[r] = beta[r]
        beta[r] = np.where(np.isinf(high[r]), beta[r] * 2, (beta[r] + high[r]) / 2)
        r = open_rows[~wide & ~done]
        high[r] = beta[r]
        beta[r] = np.where(np.isinf(low[r]), beta[r] / 2, (beta[r] + low[r]) / 2)
        open_rows = open_rows[~done]
    return {"beta": used, "entropy": entropy, "met": met, "rounds": spent, "p": p}


def attraction(y: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Sum over the edges of each i of p (y_i - y_j) / (1 + d**2)."""
    d = y[i] - y[j]
    d *= (p / (1 + np.einsum("ij,ij->i", d, d)))[:, None]
    return np.stack([np.bincount(i, d[:, k], n) for k in (0, 1)], axis=1)


def potential_sums(a: np.ndarray, b: np.ndarray, out: np.ndarray, cells: int = 1 << 16) -> None:
    """Add to ``out`` the sums over the rows of b of the squared Cauchy kernel times 1, x, y and x**2 + y**2.

    ``cells`` pairs are held at a time, so that they stay in the cache.
    """
    q = np.concatenate([np.ones((len(b), 1)), b, np.square(b).sum(axis=1, keepdims=True)], axis=1)
    bx, by = np.ascontiguousarray(b.T)
    step = max(1, cells // len(b))
    one, two = np.empty((step, len(b))), np.empty((step, len(b)))
    for lo in range(0, len(a), step):
        x = a[lo : lo + step]
        d, e = np.subtract(x[:, :1], bx, out=one[: len(x)]), np.subtract(x[:, 1:], by, out=two[: len(x)])
        d *= d
        e *= e
        d += e
        d += 1
        d *= d
        np.reciprocal(d, out=d)
        out[lo : lo + step] += d @ q


def repulsion_exact(y: np.ndarray, cells: int = 1 << 17, columns: int = 2048, rows: slice = slice(None)) -> tuple[np.ndarray, float]:
    """Pair sums: forces, and the normaliser over pairs of different points; of some ``rows`` with all, if given.

    So many rows and ``columns`` are taken at a time that ``cells`` pairs stay in the cache.
    """
    centre = y - y.mean(axis=0)
    norm = np.einsum("ij,ij->i", centre, centre)[:, None]
    one = np.ones_like(norm)
    right = np.ascontiguousarray(np.concatenate([-2 * centre, norm, one], axis=1).T)
    sums = np.concatenate([one, centre], axis=1)
    left, mine = np.concatenate([centre, one, 1 + norm], axis=1)[rows], centre[rows]
    out, z = np.empty_like(mine), 0.0
    columns = min(columns, len(y))
    step = max(1, cells // max(1, columns))
    held = np.empty((step, columns))
    for lo in range(0, len(mine), step):
        a = left[lo : lo + step]
        s = np.zeros((len(a), 3))
        for at in range(0, len(y), columns):
            b = right[:, at : at + columns]
            d = np.matmul(a, b, out=held[: len(a)]) if b.shape[1] == columns else a @ b
            np.maximum(d, 1.0, out=d)
            np.reciprocal(d, out=d)
            z += float(d.sum())
            d *= d
            s += d @ sums[at : at + columns]
        out[lo : lo + step] = mine[lo : lo + step] * s[:, :1] - s[:, 1:]
    return out, z - len(mine)


def lagrange(t: np.ndarray) -> np.ndarray:
    """Weights of the three nodes of a box at offset t in [0, 1]."""
    a, b, c = NODES
    return np.stack([(t - b) * (t - c) / ((a - b) * (a - c)), (t - a) * (t - c) / ((b - a) * (b - c)), (t - a) * (t - b) / ((c - a) * (c - b))], axis=1)


@lru_cache(maxsize=4)
def kernel_spectrum(step: float, nodes: int) -> np.ndarray:
    """Spectrum of the squared Cauchy kernel on a circulant grid twice as wide as the nodes."""
    lag = np.minimum(np.arange(2 * nodes), 2 * nodes - np.arange(2 * nodes)) * step
    d2 = np.square(lag)
    return np.fft.rfft2(1 / np.square(1 + d2[:, None] + d2[None, :]))


def convolve(weights: np.ndarray, step: float) -> np.ndarray:
    """Potentials at all nodes of weights at all nodes, ``(terms, nodes, nodes)``.

    The padding is transformed along one axis only, and what falls in it is not
    transformed back.
    """
    n = weights.shape[1]
    wide = np.fft.fft(np.fft.rfft(weights, 2 * n, axis=2), 2 * n, axis=1)
    wide *= kernel_spectrum(step, n)
    return np.fft.irfft(np.fft.ifft(wide, axis=1)[:, :n], 2 * n, axis=2)[:, :, :n]


def smooth_boxes(span: float, wanted: float = 0.5, least: int = 36, most: int = 400) -> int:
    """Boxes per dimension of width ``wanted`` at most, as a product of 2, 3, 5 and 7."""
    n = int(min(most, max(least, np.ceil(span / wanted))))
    while True:
        rest = n
        for f in (2, 3, 5, 7):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


def grid_of(y: np.ndarray, low: float, width: float, boxes: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (n, 9) and weights (n, 9) of points."""
    box = np.clip(np.floor((y - low) / width), 0, boxes - 1).astype(np.int64)
    t = (y - low) / width - box
    wx, wy = lagrange(t[:, 0]), lagrange(t[:, 1])
    gx, gy = 3 * box[:, :1] + np.arange(3), 3 * box[:, 1:] + np.arange(3)
    return (gx[:, :, None] * (3 * boxes) + gy[:, None, :]).reshape(-1, 9), (wx[:, :, None] * wy[:, None, :]).reshape(-1, 9)


def box_width(low: float, high: float, boxes: int) -> float:
    """A layout of one place gets small boxes."""
    return (high - low) / boxes if high > low else ONE_PLACE


def repulsion_fft(y: np.ndarray, boxes: int = N_BOXES, adaptive: bool = False) -> tuple[np.ndarray, float]:
    """Forces and normaliser by interpolation on a grid and convolution; O(n) besides a fixed grid."""
    low, high = float(y.min()), float(y.max())
    boxes = smooth_boxes(high - low) if adaptive else boxes
    width = box_width(low, high, boxes)
    nodes, w = grid_of(y, low, width, boxes)
    x0, x1 = y[:, 0], y[:, 1]
    sq = x0 * x0 + x1 * x1
    m = 3 * boxes
    grid = np.stack([np.bincount(nodes.ravel(), (w * q[:, None]).ravel(), m * m).reshape(m, m) for q in (np.ones(len(y)), x0, x1, sq)])
    phi = convolve(grid, width / 3).reshape(4, -1)
    p1, p2, p3, p4 = ((phi[k][nodes] * w).sum(axis=1) for k in range(4))
    z = float(((1 + sq) * p1 - 2 * (x0 * p2 + x1 * p3) + p4).sum()) - len(y)
    return np.stack([x0 * p1 - p2, x1 * p1 - p3], axis=1), z


def integrate(y: np.ndarray, u: np.ndarray, gain: np.ndarray, attr: np.ndarray, rep: np.ndarray, z: float, eta: float, exaggeration: float, momentum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of gradient descent with momentum and gains."""
    g = exaggeration * attr - rep / z
    gain = np.maximum(0.01, np.where((g < 0) != (u < 0), gain + 0.2, gain * 0.8))
    u = momentum * u - eta * gain * g
    return y + u, u, gain
