from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import coercion
from ledgerloom.operators import ingest


def one(spark, expression):
    return spark.range(1).select(expression.cast("string").alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [
        ("20240115", "2024-01-15"), ("2024-01-15 10:00", "2024-01-15"), ("2024-01-15T10:00:00Z", "2024-01-15"),
        ("2024-01-15T23:30:00+05:30", "2024-01-15"), ("2024-01-15 10:00:00.123", "2024-01-15"), ("2024-01", "2024-01-01"),
        ("1/15/24", "2024-01-15"), ("2024-01-15\t", "2024-01-15"), (" 2024-01-15\r", "2024-01-15"),
        ("2024-13-01", None), ("x", None), ("", None), (None, None),
    ],
)
def test_dates(spark, text, expected):
    date, day_first, open_order = coercion.date_readings(F.lit(text).cast("string"))
    assert one(spark, date) == expected
    assert one(spark, open_order) == str(text == "1/15/24").lower() and one(spark, day_first) is None


def test_one_order_of_month_and_day(spark):
    """A file of one date each."""
    texts = ["03/04/2024", "13/04/2024", "04/13/2024"]
    raw = spark.createDataFrame(
        [(i, text, *["1"] * 4, "A", "1") for i, text in enumerate(texts)], "file_no long, " + ", ".join(f"{c} string" for c in ingest.RAW)
    )
    found = {}
    for order in coercion.DATE_ORDERS:
        rows = ingest.validate(raw, date_order=order).sort("file_no").collect()
        found[order] = [r.date and r.date.isoformat() for r in rows]
    assert found == {
        "month": ["2024-03-04", "2024-04-13", "2024-04-13"],
        "day": ["2024-04-03", "2024-04-13", "2024-04-13"],
        "month only": ["2024-03-04", None, "2024-04-13"],
        "day only": ["2024-04-03", "2024-04-13", None],
    }
    with pytest.raises(ValueError):
        ingest.validate(raw, date_order="year")


def test_white_space_of_any_kind(spark):
    for text in ("\tSales", "Sales ", " 　Sales\r\n", "Sales"):
        assert one(spark, coercion.department(F.lit(text))) == "Sales"
    assert one(spark, coercion.department(F.lit(" "))) is None
    assert one(spark, coercion.money(F.lit("\t12.50 "))) == "12.50"
