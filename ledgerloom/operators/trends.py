"""Monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import as_double, growth, margin, trend_direction, trend_value
from ledgerloom.operators.filters import Scope
from ledgerloom.operators.rollup import labelled, monthly, monthly_departmental, with_previous


def revenue_trend(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    months = labelled(monthly(scope.apply(df)))
    return months.select("month", *as_double("revenue", "profit", "cost")).orderBy("month")


def sales_trend(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    months = labelled(monthly(scope.apply(df)))
    return months.select("month", F.col("sales_volume").cast("bigint").alias("sales")).orderBy("month")


def margin_trend(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    months = labelled(monthly(scope.apply(df)))
    return months.select("month", margin(F.col("profit"), F.col("revenue")).alias("margin")).orderBy("month")


def monthly_growth(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Growth against the previous present month; months after a month without
    positive revenue have no row."""
    months = labelled(with_previous(monthly(scope.apply(df))))
    rate = growth(F.col("revenue"), F.col("previous"))
    return (
        months.filter(F.col("previous") > 0)
        .select("month", F.round(rate, 2).alias("growth_rate"))
        .orderBy("month")
    )


def monthly_growth_by_department(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The same series inside each department; a window partition holds one
    department's months, which the calendar bounds."""
    months = labelled(with_previous(monthly_departmental(scope.apply(df)), "department"))
    rate = growth(F.col("revenue"), F.col("previous"))
    return months.filter(F.col("previous") > 0).select("department", "month", F.round(rate, 2).alias("growth_rate"))


def growth_directions(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The growth series as it is shown: up or down, and by how much."""
    rates = monthly_growth(df, scope)
    shown = [trend_direction(F.col("growth_rate")).alias("direction"), trend_value(F.col("growth_rate")).alias("value")]
    return rates.select("month", *shown)
