"""Operators for preparing training data. Nothing else in the library imports this package."""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
