"""Distances and weights as native columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def weighted_euclid(pairs: Mapping[str, tuple[Column, Column]], weights: Mapping[str, float]) -> Column:
    """``sqrt(sum w (x - y)^2)`` over named scalar columns."""
    total = F.lit(0.0)
    for name, (x, y) in pairs.items():
        d = x - y
        total = total + F.lit(float(weights.get(name, 0.0))) * d * d
    return F.sqrt(total)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; NULL when either vector has no length."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def normalized_weights(m: Column) -> Column:
    """Scale a feature -> weight map to sum 1; an all-zero map stays as it is."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    return F.when(total == 0, m).otherwise(F.transform_values(m, lambda _, v: v / total))


def key_distance(a: Column, b: Column) -> Column:
    """Steps between two pitch classes around the circle of twelve."""
    d = F.abs(a - b) % 12
    return F.least(d, F.lit(12) - d)
