"""Shared aggregations. Each is one partial + one final hash aggregate.

The monthly frame has at most one row per calendar month, whatever the size of
the fact table. Only such calendar-bounded frames go through windows without a
partition. Departments are not bounded that way and never do.

Everything here takes fact rows or the condensed ``cells`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.measures import month_label, month_start, percent_of
from ledgerloom.schema import MEASURES


def sums(df: DataFrame) -> list:
    """Sums of the measures and the number of records, of rows or of cells."""
    records = F.sum("records") if "records" in df.columns else F.count("*")
    return [F.sum(m).alias(m) for m in MEASURES] + [records.alias("records")]


def monthly(df: DataFrame) -> DataFrame:
    """Totals per month; ``month`` is the first day."""
    return df.groupBy(month_start(F.col("date")).alias("month")).agg(*sums(df))


def departmental(df: DataFrame) -> DataFrame:
    """Totals per department."""
    return df.groupBy("department").agg(*sums(df))


def monthly_departmental(df: DataFrame) -> DataFrame:
    """Totals per month and department."""
    return df.groupBy(month_start(F.col("date")).alias("month"), "department").agg(*sums(df))


def cells(df: DataFrame, *kept: str) -> DataFrame:
    """Rows condensed to one cell per month and department, dated the first of the month.

    A cell also carries the sum and the number of row margins, so every metric that
    does not look inside a month gives the same result on cells as on rows.
    ``kept`` are further columns that are the same within a cell.
    """
    row_margin = percent_of(F.col("profit"), F.col("revenue"))
    return df.groupBy(month_start(F.col("date")).alias("date"), "department", *kept).agg(
        *sums(df), F.sum(row_margin).alias("margin_sum"), F.count(row_margin).alias("margin_count")
    )


def mean_row_margin(df: DataFrame) -> Column:
    """Mean of the row margins, of rows or of cells; rows without revenue have none."""
    if "margin_sum" in df.columns:
        return F.sum("margin_sum") / F.nullif(F.sum("margin_count"), F.lit(0))
    return F.avg(percent_of(F.col("profit"), F.col("revenue")))


def with_previous(months: DataFrame, *partition: str) -> DataFrame:
    """Adds ``previous``: revenue of the previous month that has rows."""
    window = Window.partitionBy(*partition).orderBy("month") if partition else Window.orderBy("month")
    return months.withColumn("previous", F.lag("revenue").over(window))


def labelled(months: DataFrame) -> DataFrame:
    """Replaces the first day of the month by its 'yyyy-MM' text."""
    return months.withColumn("month", month_label(F.col("month")))
