"""Calendar arithmetic that counts crossed boundaries, not elapsed units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_diff(later: Column, earlier: Column) -> Column:
    """Number of year boundaries between two dates."""
    return F.year(later) - F.year(earlier)


def hour_diff(later: Column, earlier: Column) -> Column:
    """Number of hour boundaries between two zone-less timestamps."""
    return F.timestamp_diff("HOUR", F.date_trunc("hour", earlier), F.date_trunc("hour", later))


def day_diff(later: Column, earlier: Column) -> Column:
    """Number of midnights between two timestamps or dates."""
    return F.datediff(later, earlier)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def as_ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def number_text(value: Column) -> Column:
    """A double as text with whole numbers printed without a fraction (5, not 5.0)."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
