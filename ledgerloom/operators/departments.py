"""Per-department analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import (
    as_double,
    margin_or_null,
    percent_of,
    performance_class,
    performance_label,
)
from ledgerloom.operators.filters import Scope, in_month
from ledgerloom.operators.rollup import departmental, labelled, mean_row_margin, monthly_departmental


def distribution(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    totals = departmental(scope.apply(df))
    return totals.select(
        "department",
        *as_double("revenue", "profit", "cost"),
        F.col("sales_volume").cast("bigint").alias("sales"),
    )


def profitability(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Sums beside the mean of the row margins; rows without revenue have none."""
    rows = scope.apply(df)
    totals = rows.groupBy("department").agg(
        *[F.sum(c).alias(c) for c in ("revenue", "cost", "profit", "expenses")],
        mean_row_margin(rows).alias("mean_margin"),
    )
    return totals.select(
        "department",
        *as_double("revenue", "cost", "profit", "expenses"),
        F.round(F.coalesce("mean_margin", F.lit(0.0)), 2).alias("avg_row_margin"),
    )


def labels(df: DataFrame, excellent: float = 20, good: float = 10, scope: Scope = Scope()) -> DataFrame:
    """Performance label from the mean row margin."""
    rated = profitability(df, scope)
    return rated.select(
        "department",
        "avg_row_margin",
        performance_label(F.col("avg_row_margin"), excellent, good).alias("performance"),
        performance_class(F.col("avg_row_margin"), excellent, good).alias("css_class"),
    )


def top_and_worst(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """First and last department by (profit descending, name): two top-1 selections."""
    rated = profitability(df, scope)
    best = rated.orderBy(F.col("profit").desc(), F.col("department")).limit(1)
    worst = rated.orderBy(F.col("profit"), F.col("department").desc()).limit(1)
    return best.select(F.lit("top").alias("performer"), "*").unionByName(
        worst.select(F.lit("worst").alias("performer"), "*")
    )


def month_breakdown(df: DataFrame, month: str) -> DataFrame:
    """Revenue and profit per department inside one calendar month."""
    return departmental(in_month(df, month)).select("department", *as_double("revenue", "profit"))


def revenue_shares(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Every month's departments with their share of that month's revenue.

    A month's departments are not bounded, so the month totals are aggregated
    (one row per calendar month, hence small enough to broadcast) and joined
    back, instead of being a window over the month.
    """
    cells = monthly_departmental(scope.apply(df))
    totals = cells.groupBy("month").agg(F.sum("revenue").alias("month_revenue"))
    share = F.when(
        F.col("month_revenue") > 0, F.round(percent_of(F.col("revenue"), F.col("month_revenue")), 1)
    ).otherwise(F.lit(0.0))
    return labelled(cells.join(F.broadcast(totals), "month")).select(
        "month", "department", *as_double("revenue", "profit"), share.alias("share")
    )


def report_summary(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Department sheet of the report."""
    return departmental(scope.apply(df)).select(
        "department",
        *as_double("revenue", "cost", "profit"),
        F.col("sales_volume").cast("bigint").alias("sales_volume"),
        margin_or_null(F.col("profit"), F.col("revenue")).alias("profit_margin"),
    )


def names(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return scope.apply(df).select("department").distinct()
