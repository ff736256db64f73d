"""Arithmetic on array-typed feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_vector(names: Sequence[str], element: str = "float") -> Column:
    """Ordered columns packed into one array."""
    return F.array(*[F.col(name) for name in names]).cast(f"array<{element}>")


def standardise(features: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(features, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def has_nan(features: Column) -> Column:
    return F.exists(features, lambda x: F.isnan(x))


def has_inf(features: Column) -> Column:
    return F.exists(features, lambda x: F.abs(x.cast("double")) == F.lit(float("inf")))


def zeros(width: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def any_nonzero(features: Column) -> Column:
    return F.exists(features, lambda x: x != F.lit(0.0))
