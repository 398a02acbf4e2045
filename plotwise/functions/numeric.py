"""Lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nullify(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def to_number(x: Column) -> Column:
    """Double, or null for what isn't a finite number."""
    return nullify(F.trim(x.cast("string")).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where either is null or ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def safe_log1p(x: Column) -> Column:
    return F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))


def share(part: Column, rest: Column) -> Column:
    """``part / (part + rest)`` in [0, 1], 0 for an empty whole."""
    part, rest = (F.coalesce(c, F.lit(0.0)) for c in (part, rest))
    return clip(ratio(part, part + rest), 0.0, 1.0)
