"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero. Nothing is added to x before it is cut: the largest double below 0.5 would become 1."""
    whole, up = F.floor(x), F.ceil(x)
    return F.when(x >= 0, F.when(x - whole >= 0.5, up).otherwise(whole)).otherwise(F.when(up - x >= 0.5, whole).otherwise(up))
