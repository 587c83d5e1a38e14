"""Ratios as doubles: cast first, guard the divisor, round last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL where whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def is_value(column: Column, value: str, ignore_case: bool = False) -> Column:
    return (F.lower(column) if ignore_case else column) == value


def count_where(condition: Column) -> Column:
    """Rows for which the condition is true; NULL does not count."""
    return F.count(F.when(condition, 1))
