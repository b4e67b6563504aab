"""Confidence algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sanitize(c: Column) -> Column:
    """Within 0 and 1; 0.5 if it is no finite number."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.5).otherwise(clamp(c))


def noisy_or(c: Column) -> Column:
    """Aggregate: 1 - product(1 - c); 0 over no rows. Nulls do not count."""
    return clamp(1 - F.coalesce(F.product(1 - c), F.lit(1.0)))


def signed_noisy_or(c: Column, contradicts: Column) -> Column:
    """Aggregate: what supports, dampened by what contradicts."""
    return clamp(noisy_or(F.when(~contradicts, c)) * (1 - noisy_or(F.when(contradicts, c))))


def quantized(c: Column) -> Column:
    return F.round(c * 1000).cast("long")
