"""Report contents: three sheets, and the printable variant as display texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import abbreviated, currency, iso_date, percent, short_name, thousands
from ledgerloom.functions.measures import as_double, margin, trend_direction
from ledgerloom.operators.departments import report_summary
from ledgerloom.operators.filters import Scope
from ledgerloom.operators.kpis import kpi_summary

# Labels of the KPI sheet and the KPI column each one shows.
KPI_SHEET = {
    "Total Revenue": "total_revenue",
    "Total Cost": "total_cost",
    "Total Expenses": "total_expenses",
    "Net Profit": "net_profit",
    "Profit Margin (%)": "profit_margin",
    "Monthly Growth (%)": "monthly_growth",
    "Total Sales Volume": "total_sales_volume",
}


def kpi_sheet(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """One line per KPI."""
    lines = [
        F.struct(F.lit(i + 1).cast("bigint").alias("line"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for i, (label, c) in enumerate(KPI_SHEET.items())
    ]
    return kpi_summary(df, scope).select(F.inline(F.array(*lines)))


def records_sheet(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """All records in scope, in no particular order; the writer sorts inside its files."""
    return scope.apply(df).select(
        iso_date(F.col("date")).alias("date"),
        "department",
        *as_double("revenue", "cost", "expenses", "profit"),
        "sales_volume",
        margin(F.col("profit"), F.col("revenue")).alias("row_margin"),
    )


def departments_sheet(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return report_summary(df, scope)


def printed_kpis(df: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """KPI table of the printable report as texts, with the trend arrow and short form
    the dashboard shows."""
    texts = {
        "Total Revenue": currency(F.col("total_revenue")),
        "Total Cost": currency(F.col("total_cost")),
        "Net Profit": currency(F.col("net_profit")),
        "Profit Margin": percent(F.col("profit_margin")),
        "Monthly Growth": percent(F.col("monthly_growth")),
        "Total Sales Volume": thousands(F.col("total_sales_volume")),
    }
    shorts = {
        "Total Revenue": abbreviated(F.col("total_revenue")),
        "Total Cost": abbreviated(F.col("total_cost")),
        "Net Profit": abbreviated(F.col("net_profit")),
    }
    trended = {"Total Revenue", "Net Profit"}
    lines = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("line"),
            F.lit(label).alias("metric"),
            text.alias("value"),
            shorts.get(label, F.lit(None).cast("string")).alias("short_value"),
            (trend_direction(F.col("monthly_growth")) if label in trended else F.lit(None).cast("string")).alias("trend"),
        )
        for i, (label, text) in enumerate(texts.items())
    ]
    return kpi_summary(df, scope).select(F.inline(F.array(*lines)))


def printed_records(df: DataFrame, scope: Scope = Scope(), limit: int = 50) -> DataFrame:
    """First rows of the printable report, newest first, as texts."""
    newest = scope.apply(df).orderBy(F.col("date").desc(), "department", "id").limit(limit)
    return newest.select(
        iso_date(F.col("date")).alias("date"),
        short_name(F.col("department")).alias("department"),
        currency(F.col("revenue")).alias("revenue"),
        currency(F.col("cost")).alias("cost"),
        currency(F.col("profit")).alias("profit"),
        thousands(F.col("sales_volume")).alias("sales"),
    )
