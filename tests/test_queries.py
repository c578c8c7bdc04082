"""Every registered query against its SQL, and properties that tie queries together."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerloom.plans.catalog import QUERIES
from oracle_queries import ORACLE_SQL
from tools.compare import connect, difference

from paths import SMALL


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL).toPandas()
    assert difference(frame, duck.sql(ORACLE_SQL[name]).df()) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["month", "revenue", "profit", "cost"]
    assert frame.count() > 0


def test_totals_agree(spark):
    kpi = QUERIES["kpi_summary"](spark, SMALL).first()
    months = QUERIES["revenue_trend"](spark, SMALL).toPandas()
    parts = QUERIES["department_distribution"](spark, SMALL).toPandas()
    assert round(months.revenue.sum(), 2) == round(kpi.total_revenue, 2) == round(parts.revenue.sum(), 2)
    assert round(months.profit.sum(), 2) == round(kpi.net_profit, 2) == round(parts.profit.sum(), 2)
    assert parts.sales.sum() == kpi.total_sales_volume


def test_shares_add_up(spark):
    shares = QUERIES["monthly_summary_departments"](spark, SMALL).toPandas()
    assert ((shares.groupby("month").share.sum() - 100).abs() <= 0.3).all()
