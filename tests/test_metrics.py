from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import display, measures
from ledgerloom.operators import admin, departments, kpis, listing, trends
from ledgerloom.operators.filters import Scope, in_month, month_bounds, visible_to
from ledgerloom.operators.topk import top_k_per_key
from ledgerloom.plans import procedures
from ledgerloom.schema import USERS


def test_empty_input_is_all_zero(facts):
    row = kpis.kpi_summary(facts()).first()
    assert list(row) == [0, 0, 0, 0, 0, 0, 0, 0]
    assert trends.monthly_growth(facts()).count() == 0
    assert departments.top_and_worst(facts()).count() == 0


def test_single_month_has_no_growth(facts):
    row = kpis.kpi_summary(facts(("2024-01-01", "X", 100, 50, 10, 40))).first()
    assert (row.monthly_growth, row.profit_margin, row.record_count) == (0, 40, 1)


@pytest.mark.parametrize(
    "rows, growth, series",
    [
        ([("2024-01-01", "X", 100, 0, 0, 0), ("2024-03-01", "X", 150, 0, 0, 0)], 50.0, [("2024-03", 50.0)]),
        ([("2024-01-01", "X", 0, 0, 0, 0), ("2024-02-01", "X", 100, 0, 0, 0)], 0.0, []),
        ([("2024-01-01", "X", -5, 0, 0, 0), ("2024-02-01", "X", 100, 0, 0, 0)], 0.0, []),
        (
            [("2023-12-31", "X", 200, 0, 0, 0), ("2024-01-01", "X", 100, 0, 0, 0), ("2024-02-01", "X", 150, 0, 0, 0)],
            50.0,
            [("2024-01", -50.0), ("2024-02", 50.0)],
        ),
    ],
)
def test_growth_uses_previous_present_month(facts, rows, growth, series):
    df = facts(*rows)
    assert kpis.kpi_summary(df).first().monthly_growth == growth
    assert [tuple(r) for r in trends.monthly_growth(df).collect()] == series


def test_zero_revenue(spark, facts):
    df = facts(("2024-01-01", "X", 0, 5, 5, -10), ("2024-01-02", "Y", 100, 0, 0, 50), ("2024-01-03", "Y", 0, 0, 0, -9))
    rated = {r.department: r.avg_row_margin for r in departments.profitability(df).collect()}
    assert rated == {"X": 0.0, "Y": 50.0}
    performance = {r.department: r.profit_margin for r in procedures.department_performance(spark, df).collect()}
    assert performance == {"X": None, "Y": 41.0}
    assert kpis.kpi_summary(df.filter("department = 'X'")).first().profit_margin == 0


def test_top_and_worst_ties(facts):
    df = facts(*[("2024-01-01", d, 10, 0, 0, 5) for d in "CAB"])
    assert {r.performer: r.department for r in departments.top_and_worst(df).collect()} == {"top": "A", "worst": "C"}


def test_scope_is_inclusive_and_all_means_all(facts):
    df = facts(*[(f"2024-01-0{i}", "X" if i % 2 else "Y", i, 0, 0, 0) for i in range(1, 8)])
    assert Scope("2024-01-02", "2024-01-05").apply(df).count() == 4
    assert Scope(department="all").apply(df).count() == 7
    assert Scope(department="", start="").apply(df).count() == 7
    assert Scope("2024-01-02", department="X").apply(df).count() == 3


def test_month_bounds():
    assert month_bounds("2024-1") == month_bounds("2024-01") == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert month_bounds("2023-12") == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))


def test_month_filter_edges(facts):
    df = facts(("2023-12-31", "X", 1, 0, 0, 0), ("2024-01-01", "X", 2, 0, 0, 0), ("2024-01-31", "X", 3, 0, 0, 0), ("2024-02-01", "X", 4, 0, 0, 0))
    assert in_month(df, "2024-01").agg(F.sum("revenue")).first()[0] == 5


def test_visibility(spark, facts):
    users = spark.createDataFrame(
        [(1, "a", "a@x", "Admin", True, None, None), (2, "b", "b@x", "Analyst", True, None, None)], USERS
    )
    df = facts(
        ("2024-01-01", "X", 1, 0, 0, 0, 1, 1), ("2024-01-02", "X", 2, 0, 0, 0, 1, 2), ("2024-01-03", "X", 4, 0, 0, 0, 1, None)
    )
    assert visible_to(df, users, 1).count() == 3
    assert visible_to(df, users, 2).count() == 1
    assert visible_to(df, users, 99).count() == 0
    totals = {r.viewer: (r.visible_records, r.visible_revenue) for r in admin.owner_scoped_totals(users, df).collect()}
    assert totals == {1: (3, 7.0), 2: (1, 2.0)}


def test_user_activity_does_not_multiply(spark, facts):
    users = spark.createDataFrame([(1, "a", "a@x", "Admin", True, None, None), (2, "b", "b@x", "Analyst", True, None, None)], USERS)
    df = facts(*[(f"2024-01-0{i}", "X", 1, 0, 0, 0, 1, 1) for i in range(1, 6)])
    history = spark.createDataFrame([(i, 1) for i in range(3)], "id long, uploaded_by long")
    found = {r.user_id: (r.upload_count, r.data_records) for r in admin.user_activity(users, history, df).collect()}
    assert found == {1: (3, 5), 2: (0, 0)}


def test_pages(facts):
    df = facts(*[(f"2024-01-{i:02d}", d, i, 0, 0, 0) for i in range(1, 29) for d in "AB"])
    keys = lambda page: [(r.date, r.department) for r in page.collect()]
    everything = sorted(((f"2024-01-{i:02d}", d) for i in range(1, 29) for d in "AB"), key=lambda k: (-int(k[0][-2:]), k[1]))
    assert keys(listing.records_page(df, 2, 20)) == everything[20:40]
    assert keys(listing.records_page(df, 9, 20)) == []
    assert keys(listing.records_after(df, *everything[19], 20)) == everything[20:40]
    assert tuple(listing.page_info(df, 2, 20).first()) == (56, 3, 2)
    assert tuple(listing.page_info(df, 1, 1000).first()) == (56, 1, 1)


def test_top_k_per_hot_key(spark):
    """One key holds most rows; the result equals a plain ranking."""
    df = spark.range(20_000).selectExpr("id", "if(id % 10 < 8, 0, id % 10) as owner", "hash(id) as score")
    mine = top_k_per_key(df, ["owner"], [F.col("score").desc(), F.col("id")], 7, F.col("id"))
    rows = df.toPandas().sort_values(["score", "id"], ascending=[False, True]).groupby("owner").head(7)
    assert {tuple(r) for r in mine.select("owner", "id").collect()} == set(zip(rows.owner, rows.id))


def test_display_texts(spark):
    row = spark.range(1).select(
        display.abbreviated(F.lit(1234567)).alias("m"),
        display.abbreviated(F.lit(1000)).alias("k"),
        display.abbreviated(F.lit(-5000000)).alias("n"),
        display.currency(F.lit(-1234.5)).alias("c"),
        display.thousands(F.lit(1234567)).alias("t"),
        display.percent(F.lit(12.345), 1).alias("p"),
        display.short_name(F.lit("4-NOT SPECIFIED AT ALL")).alias("s"),
        display.short_date(F.lit("2024-03-05").cast("date")).alias("d"),
        display.short_date(F.lit(None).cast("date")).alias("d0"),
        display.status_label(F.lit("partial")).alias("l"),
        display.file_kind(F.lit("a.xlsx")).alias("f"),
        display.iso(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("i"),
        display.iso(F.lit("2024-01-02 03:04:05.006").cast("timestamp")).alias("i6"),
        measures.performance_label(F.lit(20.0)).alias("a"),
        measures.performance_label(F.lit(10.0)).alias("b"),
        measures.performance_label(F.lit(9.99)).alias("z"),
        measures.trend_direction(F.lit(0.0)).alias("up"),
    ).first()
    assert row.asDict() == {
        "m": "1.23M", "k": "1.00K", "n": "-5000000.00", "c": "$-1,234.50", "t": "1,234,567", "p": "12.3%",
        "s": "4-NOT SPECIFIED", "d": "Mar 5, 2024", "d0": "-", "l": "Partial", "f": "excel",
        "i": "2024-01-02T03:04:05", "i6": "2024-01-02T03:04:05.006000", "a": "Excellent", "b": "Good",
        "z": "Needs Attention", "up": "up",
    }


def test_views_by_name(spark, facts):
    procedures.register_views(spark, facts(("2024-01-01", "X", 100, 50, 10, 40), ("2024-02-01", "Y", 0, 0, 0, 1)))
    rows = spark.sql("SELECT month, profit_margin FROM monthly_summary").collect()
    assert [tuple(r) for r in rows] == [("2024-02", None), ("2024-01", 40.0)]
    assert spark.sql("SELECT count(*) FROM department_summary").first()[0] == 2


def test_procedure_month_and_department(spark, facts):
    df = facts(("2024-12-31", "X", 100, 50, 10, 40), ("2024-12-01", "Y", 50, 0, 0, 1), ("2025-01-01", "X", 7, 0, 0, 0))
    assert procedures.monthly_kpis(spark, df, 2024, 12).first().total_revenue == 150
    assert procedures.monthly_kpis(spark, df, 2024, 12, "X").first().total_revenue == 100
    assert procedures.monthly_kpis(spark, df, 2020, 1).first().total_revenue is None
