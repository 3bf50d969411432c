"""Small gradient-boosted trees, fitted on a bounded table and evaluated as SQL.

Logistic loss, trees of two levels, exact splits over the distinct values. The
fit runs on the driver over at most a few thousand rows; scores are CASE
expressions, so scoring stays inside the plan.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Trees:
    """Boosted trees: ``base`` plus the sum of the leaves that a row falls in."""

    def __init__(self, names: list[str], base: float, trees: list):
        self.names, self.base, self.trees = names, base, trees

    @staticmethod
    def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rate: float, ridge: float):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    left = x[rows, f] <= cut
                    gl, hl = grad[rows[left]].sum(), hess[rows[left]].sum()
                    gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        _, f, cut = best
        if f is None:
            return float(-rate * g / (h + ridge))
        left = x[rows, f] <= cut
        grow = lambda part: Trees._grow(x, grad, hess, part, depth - 1, rate, ridge)
        return f, cut, grow(rows[left]), grow(rows[~left])

    @classmethod
    def fit(cls, names: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 2, rate: float = 0.3, ridge: float = 1.0) -> "Trees":
        share = np.clip(y.mean(), 0.01, 0.99)
        model = cls(names, float(np.log(share / (1 - share))), [])
        score = np.full(len(y), model.base)
        for _ in range(rounds):
            p = sigmoid(score)
            tree = cls._grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, rate, ridge)
            model.trees.append(tree)
            score += model._walk(tree, x)
        return model

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] <= cut, self._walk(left, x), self._walk(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._walk(t, x) for t in self.trees)

    def sql(self, row: str) -> str:
        """The margin of ``row``, a struct with the features as fields."""

        def text(tree) -> str:
            if isinstance(tree, float):
                return f"{tree:.9f}D"
            f, cut, left, right = tree
            return f"CASE WHEN {row}.{self.names[f]} <= {cut:.6f}D THEN {text(left)} ELSE {text(right)} END"

        return " + ".join([f"{self.base:.9f}D", *(f"({text(t)})" for t in self.trees)])


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling on held-out rows: ``a, b`` so that sigmoid(a * margin + b) is a probability."""
    a, b = 1.0, 0.0
    # pulled-in targets keep the slope finite when classes part cleanly
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        w, d = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * margin).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)
