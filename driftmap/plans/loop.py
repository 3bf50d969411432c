"""The optimiser's loop over arrays, shared by the engines that hold a layout in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.kernels import integrate, repulsion_exact, repulsion_fft
from ..options import Options

#: Points up to which exact pair sums are used when the choice is free.
EXACT_POINTS = 5_000


@dataclass
class State:
    y: np.ndarray
    u: np.ndarray
    gain: np.ndarray
    z: float | None = None
    norm: float | None = None


def kept_moves(opt: Options) -> set[int]:
    """Numbers of moves after which a snapshot is due, the final one aside."""
    if opt.return_style == "once":
        return set()
    steps = opt.snapshot_steps()[:-1]
    return {s + 1 for s in steps} if opt.snapshot_compat else set(steps)


def sums_pairs(opt: Options, n: int) -> bool:
    """Does repulsion sum over all pairs of n points?"""
    return opt.repulsion == "exact" or (opt.repulsion == "auto" and n <= EXACT_POINTS)


def repel(y: np.ndarray, opt: Options) -> tuple[np.ndarray, float]:
    return repulsion_exact(y) if sums_pairs(opt, len(y)) else repulsion_fft(y, opt.n_boxes, opt.adaptive_boxes)


def run(state: State, attract: Callable[[np.ndarray], np.ndarray], opt: Options, first_step: int = 0, repulse: Callable[[np.ndarray], tuple[np.ndarray, float]] | None = None) -> Iterator[tuple[str, int, State]]:
    """Yield ``(kind, moves, state)``: snapshots, dumps, metrics, and the final state once.

    ``repulse`` gives forces and normaliser of a layout; by default they are found here.
    The stopping rule is checked after a move, before that move is observed.
    """
    snapshots, step = kept_moves(opt), first_step
    if step in snapshots:
        yield "snapshot", step, state
    while step != opt.n_iter:
        attr = attract(state.y)
        rep, z = repulse(state.y) if repulse else repel(state.y, opt)
        y, u, gain = integrate(state.y, state.u, state.gain, attr, rep, z, opt.learning_rate, opt.exaggeration(step), opt.momentum(step))
        state, step = State(y, u, gain, z, float(np.sqrt(np.square(u).sum()))), step + 1
        if opt.min_grad_norm > 0 and state.norm < opt.min_grad_norm:
            break
        if step in snapshots and step != opt.n_iter:
            yield "snapshot", step, state
        if opt.dump_points and (step - 1) % opt.dump_interval == 0:
            yield "dump", step, state
        if opt.verbose and (step - 1) % opt.print_interval == 0:
            yield "metric", step, state
    yield "final", step, state
