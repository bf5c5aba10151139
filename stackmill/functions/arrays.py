"""Expressions over feature arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def finite_or_zero(x: Column) -> Column:
    """Missing, NaN and infinite values become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def clean(values: Column) -> Column:
    return F.transform(values, finite_or_zero)


def numeric_or_zero(text: Column) -> Column:
    """Parse text as a double; what does not parse, or parses to NaN, becomes 0."""
    parsed = text.try_cast("double")
    return F.when(parsed.isNull() | F.isnan(parsed), F.lit(0.0)).otherwise(parsed)


def keep_positions(values: Column, positions: Sequence[int]) -> Column:
    """The elements at the given 0-based positions, in the given order."""
    wanted = F.array(*[F.lit(int(p) + 1) for p in positions])
    return F.transform(wanted, lambda p: F.element_at(values, p))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def minmax(values: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); a feature that is constant in the fit rows is only shifted. No clipping."""

    def scale(x: Column, i: Column) -> Column:
        lo, hi = F.get(low, i), F.get(high, i)
        return (x - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)

    return F.transform(values, scale)


def standardize(values: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a feature that is constant in the fit rows is only shifted."""

    def scale(x: Column, i: Column) -> Column:
        sd = F.get(std, i)
        return (x - F.get(mean, i)) / F.when(sd == 0.0, F.lit(1.0)).otherwise(sd)

    return F.transform(values, scale)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
