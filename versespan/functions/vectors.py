"""Vector distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None,
                    norm_b: Column | None = None) -> Column:
    """1 - cosine; NaN (which sorts last) when either vector has no length."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(
        F.lit(1.0) - dot(a, b) / F.nullif(scale, F.lit(0.0)))
