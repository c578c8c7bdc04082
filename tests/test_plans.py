"""Physical plans: what reaches the scan, what is shuffled, what must not appear."""

from __future__ import annotations

import pytest

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources import adapter

from paths import SMALL

WRITING = {name for name in QUERIES if name.startswith(("report_files", "csv_", "seed_", "stream_", "ledger_"))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_python_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan


def test_month_and_scope_reach_the_scan(spark):
    plan = plan_of(QUERIES["kpi_month"](spark, SMALL))
    scan = next(line for line in plan.split("\n") if "l_shipdate" in line and "PushedFilters" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["sales_trend"](spark, SMALL))
    scan = next(line for line in plan.split("\n") if "lineitem" in line)
    schema = scan[scan.index("ReadSchema") :]
    assert "l_extendedprice" not in schema and "l_discount" not in schema and "l_tax" not in schema


@pytest.mark.parametrize("name", ["records_page", "alerts_latest", "upload_history_latest", "report_display_rows", "user_records"])
def test_latest_rows_are_a_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["user_recent_records", "user_recent_uploads", "ingest_error_summary"])
def test_rankings_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 3 and "Partial" in plan


def test_windows_without_partition_see_monthly_rows_only(spark):
    """Below every single-partition exchange of a window there is the monthly aggregate."""
    for name in ("kpi_summary", "monthly_growth"):
        lines = plan_of(QUERIES[name](spark, SMALL)).split("\n")
        at = next(i for i, line in enumerate(lines) if "Window [lag" in line)
        below = next(line for line in lines[at + 1 :] if "HashAggregate" in line)
        assert "trunc(" in below or "_groupingexpression" in below or "month" in below


@pytest.mark.parametrize("name", ["alerts_generated", "alerts_new", "quality_checks"])
def test_facts_are_read_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert sum("FileScan" in line and "lineitem" in line for line in plan.split("\n")) == 1


def test_procedures_are_sql_functions(spark):
    plan = plan_of(QUERIES["sql_monthly_kpis"](spark, SMALL))
    scan = next(line for line in plan.split("\n") if "l_shipdate" in line and "PushedFilters" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    rows = spark.sql("SELECT * FROM get_department_performance() ORDER BY total_profit DESC").collect()
    assert [r.department for r in rows][:1] == ["1-URGENT"]


def test_facts_combine_before_the_shuffle(spark):
    plan = plan_of(adapter.business_data(spark, SMALL))
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_deep_pages_order_only_their_dates(spark, facts):
    from ledgerloom.operators import listing

    df = facts(*[(f"2024-01-{i:02d}", d, i, 0, 0, 0) for i in range(1, 29) for d in "AB"])
    plan = plan_of(listing.records_page(df, 5, 10))
    # 40 rows precede the page: the rows of 20 dates, none of which is read again.
    assert "date" in plan and ">= 2024-01-04" in plan and "<= 2024-01-08" in plan
    assert "CollectLimit" not in plan and "TakeOrderedAndProject(limit=10" in plan
