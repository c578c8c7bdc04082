from __future__ import annotations

import datetime as dt

import pytest

from ledgerloom.operators import alerts
from ledgerloom.schema import ALERTS

NOW = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("2024-01-01", "X", 100, 90, 0, 10)], set()),
        ([("2024-01-01", "X", 10000, 9001, 0, 999)], {("low_margin", "X")}),
        ([("2024-01-01", "X", 0, 5, 5, -10)], {("low_margin", "X"), ("expense_exceed", "X")}),
        ([("2024-01-01", "X", 100, 0, 100, 50)], set()),
        ([("2024-01-01", "X", 100, 0, 0, 50), ("2024-02-01", "X", 90, 0, 0, 50)], set()),
        ([("2024-01-01", "X", 10000, 0, 0, 5000), ("2024-02-01", "X", 8999, 0, 0, 5000)], {("revenue_drop", None)}),
        ([("2024-01-01", "X", 0, 0, 0, 0), ("2024-02-01", "X", -5, 0, 0, 0)], {("low_margin", "X"), ("expense_exceed", "X")}),
        ([], set()),
    ],
)
def test_thresholds(facts, rows, expected):
    assert {(r.type, r.department) for r in alerts.evaluate(facts(*rows)).collect()} == expected


def test_messages(facts):
    df = facts(("2024-01-01", "X", 1000, 0, 2000, 50), ("2024-02-01", "X", 500, 0, 0, 10))
    found = {r.type: (r.message, r.severity) for r in alerts.evaluate(df).collect()}
    assert found == {
        "low_margin": ("Low profit margin (4.0%) detected in X", "warning"),
        "expense_exceed": ("Expenses exceed revenue in X!", "danger"),
        "revenue_drop": ("Revenue dropped by 50.0% compared to last month", "danger"),
    }


def test_thresholds_are_arguments(facts):
    df = facts(("2024-01-01", "X", 100, 0, 0, 30), ("2024-02-01", "X", 95, 0, 0, 30))
    assert alerts.evaluate(df).count() == 0
    assert alerts.evaluate(df, margin_threshold=40, drop_threshold=4).count() == 2


def test_second_run_adds_none_until_read(spark, facts, no_alerts):
    df = facts(("2024-01-01", "X", 1000, 0, 2000, 50), ("2024-02-01", "X", 500, 0, 0, 10))
    first = alerts.new_alerts(df, no_alerts, NOW)
    assert first.count() == 3
    assert first.filter("id < 0").count() == 0
    assert alerts.new_alerts(df, first, NOW).count() == 0
    drop = first.filter("type = 'revenue_drop'").select("id")
    marked = alerts.mark_read(first, drop)
    assert marked.filter("is_read").count() == 1
    assert [r.type for r in alerts.new_alerts(df, marked, NOW).collect()] == ["revenue_drop"]
    assert alerts.new_alerts(df, alerts.mark_all_read(first), NOW).count() == 3


def test_suppression_keys(spark, facts):
    """Another department's open alert does not suppress; an open drop does, whatever its department."""
    df = facts(("2024-01-01", "X", 1000, 0, 0, 50), ("2024-02-01", "X", 500, 0, 0, 10))
    rows = [
        (1, "low_margin", "", "warning", "Y", False, NOW),
        (2, "low_margin", "", "warning", None, False, NOW),
        (3, "revenue_drop", "", "danger", "Z", False, NOW),
    ]
    existing = spark.createDataFrame(rows, ALERTS)
    assert [r.type for r in alerts.new_alerts(df, existing, NOW).collect()] == ["low_margin"]
