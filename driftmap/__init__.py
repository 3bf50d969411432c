"""Neighbour-embedding engine on Spark DataFrames."""

from .options import Options
from .plans.estimator import TSNE
from .plans.fit import FitResult, affinities, fit, fit_groups

__all__ = ["TSNE", "FitResult", "Options", "affinities", "fit", "fit_groups"]
