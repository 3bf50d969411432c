"""The estimator: options as keyword arguments, then ``fit_transform``."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from ..options import Options
from ..sources.trajectory import write_text
from ..sources.vectors import vectorise
from .fit import FitResult, fit

#: Arguments that are accepted for compatibility and change nothing.
IGNORED = ("theta", "epssq", "magnitude_factor", "n_iter_without_progress", "device", "use_interactive", "viz_server", "viz_timeout", "method", "angle")


class TSNE:
    """t-distributed stochastic neighbour embedding of the rows of a DataFrame.

    Takes the options of ``Options`` as keywords. ``fit_transform`` gives
    ``id, x, y``, or with ``return_style="snapshots"`` ``snapshot, step, id, x,
    y``. After it, ``result`` has all tables of the fit.
    """

    def __init__(self, n_components: int = 2, **options):
        dropped = [k for k in options if k in IGNORED]
        if dropped:
            warnings.warn(f"no effect: {', '.join(dropped)}", stacklevel=2)
        if options.get("random_seed", 0) is None:
            options["random_seed"] = 0
        self.options = Options(n_components=n_components, **{k: v for k, v in options.items() if k not in IGNORED}).validate()
        self.result: FitResult | None = None

    def fit_transform(self, df: DataFrame, id_col: str = "id", features: str | list[str] = "features", y: DataFrame | None = None) -> DataFrame:
        points = vectorise(df, id_col, features)
        self.result = fit(points, self.options, y)
        if self.options.dump_points:
            write_text(self.result.trajectory, self.options.dump_file)
        return self.result.snapshots if self.options.return_style == "snapshots" else self.result.layout
