"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(v: Column) -> Column:
    """Doubles, with NaN and null components as 0."""
    return F.transform(v.cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    return dot(a, b) / ((length(a) + guard) * (length(b) + guard))


def clipped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)
