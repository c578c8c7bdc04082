"""Column expressions for ratios, growth, months and labels.

Money stays exact DECIMAL up to the last step; ratios are taken between two
doubles cast from exact sums, then rounded.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100 as a double; NULL where whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100


def margin(profit: Column, revenue: Column, digits: int = 2) -> Column:
    """Rounded margin, 0 unless revenue is positive."""
    return F.when(revenue > 0, F.round(percent_of(profit, revenue), digits)).otherwise(F.lit(0.0))


def margin_or_null(profit: Column, revenue: Column, digits: int = 2) -> Column:
    """Rounded margin, NULL on zero revenue (the stored procedures and views)."""
    return F.round(percent_of(profit, revenue), digits)


def growth(current: Column, previous: Column) -> Column:
    """Unrounded change against ``previous`` in percent; NULL unless previous > 0."""
    return F.when(previous > 0, percent_of(current - previous, previous))


def month_start(date: Column) -> Column:
    """First day of the month: a 4-byte grouping key instead of a string."""
    return F.trunc(date, "MM")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def performance_label(percent: Column, excellent: float = 20, good: float = 10) -> Column:
    return (
        F.when(percent >= excellent, "Excellent").when(percent >= good, "Good").otherwise("Needs Attention")
    )


def performance_class(percent: Column, excellent: float = 20, good: float = 10) -> Column:
    return (
        F.when(percent >= excellent, "text-success").when(percent >= good, "text-warning").otherwise("text-danger")
    )


def trend_direction(percent: Column) -> Column:
    return F.when(percent >= 0, "up").otherwise("down")


def trend_value(percent: Column) -> Column:
    """Size of a change as it is shown beside its direction: one decimal, without sign."""
    return F.round(F.abs(percent), 1)


def as_double(*names: str) -> list[Column]:
    """Output form of exact money columns."""
    return [F.col(n).cast("double").alias(n) for n in names]


def moment(value: dt.datetime, kind: T.DataType | str = "timestamp") -> Column:
    """A timestamp literal. The value has no zone and means UTC, whatever the zone of
    the machine that runs the driver."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
