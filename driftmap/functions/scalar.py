"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def increment_inverse(x: Column) -> Column:
    """1 / (x + 1), the Student-t kernel of a squared distance."""
    return 1 / (x + 1)


def squared_cauchy(dx: Column, dy: Column) -> Column:
    """(1 + dx**2 + dy**2) ** -2."""
    d = 1 + dx * dx + dy * dy
    return 1 / (d * d)


def entropy_term(x: Column) -> Column:
    """x ln x, 0 where that is undefined."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def kl_term(x: Column, y: Column) -> Column:
    """x (ln x - ln y), 0 for x = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * (F.ln(x) - F.ln(y)))


def square(x: Column) -> Column:
    return x * x


def power2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def nan_or_inf(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def gaussian(d: Column, beta: Column) -> Column:
    return F.exp(-beta * d)


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def signed(x: Column) -> Column:
    """Whether the sign bit of x counts as set; +0 and -0 count as positive."""
    return x < 0
