"""Column expressions for texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO 8601 text of a timestamp; the fraction appears only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ts == F.date_trunc("second", ts), whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def abbreviated(value: Column) -> Column:
    """1234567 -> 1.23M, 1234 -> 1.23K; smaller and negative numbers in full."""
    v = value.cast("double")
    return (
        F.when(v >= 1_000_000, F.format_string("%.2fM", v / 1_000_000))
        .when(v >= 1_000, F.format_string("%.2fK", v / 1_000))
        .otherwise(F.format_string("%.2f", v))
    )


def currency(value: Column) -> Column:
    return F.format_string("$%,.2f", value.cast("double"))


def thousands(value: Column) -> Column:
    return F.format_string("%,d", value.cast("bigint"))


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value.cast("double"))


def short_name(department: Column, length: int = 15) -> Column:
    return F.substring(department, 1, length)


def short_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "MMM d, yyyy"), F.lit("-"))


def status_label(status: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(status, 1, 1)), F.substr(status, F.lit(2)))


def status_icon(status: Column) -> Column:
    return F.when(status == "success", "check").when(status == "partial", "exclamation").otherwise("times")


def file_kind(filename: Column) -> Column:
    return F.when(filename.endswith(".csv"), "csv").otherwise("excel")
