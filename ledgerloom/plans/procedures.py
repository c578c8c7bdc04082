"""The stored procedures and views: named, parameterised entry points to the rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.measures import margin_or_null
from ledgerloom.operators.rollup import sums, departmental, labelled, monthly

# How the procedures and views name the totals.
TOTALS = {"revenue": "total_revenue", "cost": "total_cost", "expenses": "total_expenses", "profit": "total_profit"}


def _totals(*measures: str, **renamed: str) -> list[Column]:
    """The totals of a rollup, the volume and the margin, which is NULL without revenue."""
    money = [F.col(m).cast("double").alias(renamed.get(m, TOTALS[m])) for m in measures]
    volume = F.col("sales_volume").cast("bigint").alias("total_sales")
    return [*money, volume, margin_or_null(F.col("profit"), F.col("revenue")).alias("profit_margin")]


def monthly_kpis(spark: SparkSession, facts: DataFrame, year: int, month: int, department: str | None = None) -> DataFrame:
    """Month KPIs; the month is a range of dates, so both bounds reach the scan."""
    first = dt.date(year, month, 1)
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    rows = facts.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(after)))
    if department is not None:
        rows = rows.filter(F.col("department") == department)
    return rows.agg(*sums(rows)).select(*_totals("revenue", "cost", "expenses", "profit", profit="net_profit"))


def department_performance(spark: SparkSession, facts: DataFrame) -> DataFrame:
    return (
        departmental(facts)
        .select("department", *_totals("revenue", "cost", "profit"), F.col("records").alias("record_count"))
        .orderBy(F.desc("total_profit"), "department")
    )


def monthly_summary(spark: SparkSession, facts: DataFrame) -> DataFrame:
    totals = labelled(monthly(facts)).select("month", *_totals("revenue", "cost", "profit", "expenses"))
    return totals.orderBy(F.desc("month"))


def department_summary(spark: SparkSession, facts: DataFrame) -> DataFrame:
    return departmental(facts).select(
        "department", *_totals("revenue", "cost", "profit", "expenses"), F.col("records").alias("record_count")
    )


def register_views(spark: SparkSession, facts: DataFrame) -> None:
    """Makes business_data, monthly_summary and department_summary queryable by name."""
    facts.createOrReplaceTempView("business_data")
    monthly_summary(spark, facts).createOrReplaceTempView("monthly_summary")
    department_summary(spark, facts).createOrReplaceTempView("department_summary")


def register_functions(spark: SparkSession, facts: DataFrame) -> None:
    """Makes the procedures SQL table functions over business_data.

    SELECT * FROM get_monthly_kpis(1998, 3, NULL)
    SELECT * FROM get_department_performance()

    Calls are inlined into the query, so the month's bounds reach the scan.
    """
    register_views(spark, facts)
    totals = """CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
        {0} CAST(SUM(profit) AS DOUBLE) AS {1}, CAST(SUM(sales_volume) AS BIGINT) AS total_sales,
        ROUND(CAST(SUM(profit) AS DOUBLE) / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0D) * 100, 2) AS profit_margin"""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_monthly_kpis(p_year INT, p_month INT, p_department STRING)
        RETURNS TABLE (total_revenue DOUBLE, total_cost DOUBLE, total_expenses DOUBLE, net_profit DOUBLE,
                       total_sales BIGINT, profit_margin DOUBLE)
        RETURN SELECT {totals.format("CAST(SUM(expenses) AS DOUBLE) AS total_expenses,", "net_profit")}
        FROM business_data
        WHERE date >= make_date(p_year, p_month, 1) AND date < add_months(make_date(p_year, p_month, 1), 1)
          AND (p_department IS NULL OR department = p_department)""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_department_performance()
        RETURNS TABLE (department STRING, total_revenue DOUBLE, total_cost DOUBLE, total_profit DOUBLE,
                       total_sales BIGINT, profit_margin DOUBLE, record_count BIGINT)
        RETURN SELECT department, {totals.format("", "total_profit")}, COUNT(*) AS record_count
        FROM business_data GROUP BY department""")
