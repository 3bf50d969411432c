"""Options of a fit, checked before any work is planned."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

METRICS = ("euclidean", "innerproduct")
RETURN_STYLES = ("once", "snapshots")
ENGINES = ("auto", "single_task", "distributed", "dataframe")


@dataclass(frozen=True)
class Options:
    """Parameters of a fit.

    ``num_neighbors`` counts the point itself, so ``num_neighbors - 1`` others
    take part. A negative ``n_iter`` runs until ``min_grad_norm`` stops the fit.
    """

    n_components: int = 2
    perplexity: float = 50.0
    early_exaggeration: float = 12.0
    learning_rate: float = 200.0
    num_neighbors: int = 32
    force_magnify_iters: int = 250
    pre_momentum: float = 0.5
    post_momentum: float = 0.8
    n_iter: int = 1000
    min_grad_norm: float = 0.0
    perplexity_epsilon: float = 1e-3
    metric: str = "euclidean"
    init: str = "random"
    return_style: str = "once"
    num_snapshots: int = 5
    snapshot_compat: bool = False
    verbose: int = 0
    print_interval: int = 10
    dump_points: bool = False
    dump_file: str = "dump.txt"
    dump_interval: int = 1
    random_seed: int = 0
    symmetrize: str = "one_sided"
    knn: str = "exact"
    nprobe: int = 20
    n_boxes: int = 130
    adaptive_boxes: bool = False
    repulsion: str = "auto"
    engine: str = "auto"

    def validate(self) -> "Options":
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        if self.n_components != 2:
            raise NotImplementedError("n_components must be 2")
        need(self.metric in ("L2", *METRICS), f"metric must be one of {METRICS}")
        need(self.init in ("random", "gaussian", "uniform"), "init must be random, gaussian or uniform")
        need(self.return_style in RETURN_STYLES, f"return_style must be one of {RETURN_STYLES}")
        need(self.engine in ENGINES, f"engine must be one of {ENGINES}")
        need(self.symmetrize in ("one_sided", "full"), "symmetrize must be one_sided or full")
        need(self.knn in ("exact", "ivf"), "knn must be exact or ivf")
        need(self.repulsion in ("auto", "exact", "fft"), "repulsion must be auto, exact or fft")
        need(self.perplexity > 0 and self.num_neighbors >= 2 and self.perplexity_epsilon > 0, "perplexity, num_neighbors and perplexity_epsilon must be positive, with a neighbour besides the point itself")
        need(self.n_iter >= 0 or self.min_grad_norm > 0, "an endless fit needs min_grad_norm")
        need(self.dump_interval > 0 and self.print_interval > 0, "intervals must be positive")
        if self.return_style == "snapshots":
            need(self.num_snapshots >= 2, "num_snapshots must be 2 or more")
            need(self.n_iter >= self.num_snapshots - 1, "fewer steps than snapshots")
        if self.perplexity > self.num_neighbors - 1:
            warnings.warn("perplexity is out of reach of num_neighbors: affinities will be nearly uniform; use num_neighbors >= 3 * perplexity", stacklevel=3)
        return self

    def exaggeration(self, step: int) -> float:
        return self.early_exaggeration if step < self.force_magnify_iters else 1.0

    def momentum(self, step: int) -> float:
        return self.pre_momentum if step < self.force_magnify_iters else self.post_momentum

    def snapshot_steps(self) -> list[int]:
        """Steps after which a layout is kept, the final one last.

        Exactly ``num_snapshots`` even steps; with ``snapshot_compat`` every
        multiple of ``n_iter // (num_snapshots - 1)`` and the final layout.
        """
        if self.return_style == "once" or self.n_iter < 0:
            return [self.n_iter]
        if self.snapshot_compat:
            every = self.n_iter // (self.num_snapshots - 1)
            return [*range(0, self.n_iter, every), self.n_iter]
        return sorted({round(k * self.n_iter / (self.num_snapshots - 1)) for k in range(self.num_snapshots)})
