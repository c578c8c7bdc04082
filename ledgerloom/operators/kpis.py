"""KPI totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import growth, margin
from ledgerloom.operators.filters import Scope, in_month
from ledgerloom.operators.rollup import monthly, with_previous


def kpi_summary(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The eight KPIs as one row, all zero on empty input.

    Totals and growth come from the same monthly frame, so the fact table is
    read once and only one small exchange is needed.
    """
    totals = with_previous(monthly(scope.apply(df))).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("revenue", "cost", "expenses", "profit")],
        F.coalesce(F.sum("sales_volume"), F.lit(0)).alias("sales_volume"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.max_by("revenue", "month").alias("current"),
        F.max_by("previous", "month").alias("previous"),
    )
    rate = F.coalesce(growth(F.col("current"), F.col("previous")), F.lit(0.0))
    return totals.select(
        F.col("revenue").cast("double").alias("total_revenue"),
        F.col("cost").cast("double").alias("total_cost"),
        F.col("expenses").cast("double").alias("total_expenses"),
        F.col("profit").cast("double").alias("net_profit"),
        margin(F.col("profit"), F.col("revenue")).alias("profit_margin"),
        F.col("sales_volume").cast("bigint").alias("total_sales_volume"),
        F.round(rate, 2).alias("monthly_growth"),
        F.col("records").cast("bigint").alias("record_count"),
    )


def month_kpis(df: DataFrame, month: str) -> DataFrame:
    """KPIs of one calendar month."""
    return kpi_summary(in_month(df, month))
