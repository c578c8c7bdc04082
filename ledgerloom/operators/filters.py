"""Row filters. All are plain predicates on stored columns, so they reach the scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import moment


def parse_day(value: str | dt.date | None) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


@dataclass(frozen=True)
class Scope:
    """What every metric accepts: inclusive dates, a department, an owner."""

    start: str | dt.date | None = None
    end: str | dt.date | None = None
    department: str | None = None
    owner: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        start, end = parse_day(self.start), parse_day(self.end)
        if start is not None:
            df = df.filter(F.col("date") >= F.lit(start))
        if end is not None:
            df = df.filter(F.col("date") <= F.lit(end))
        if self.department and self.department != "all":
            df = df.filter(F.col("department") == self.department)
        if self.owner is not None:
            df = owned_by(df, self.owner)
        return df


def owned_by(df: DataFrame, user_id: int) -> DataFrame:
    """Rows of one owner; rows without an owner are seen by nobody here."""
    return df.filter(F.col("created_by") == user_id)


def visible_to(df: DataFrame, users: DataFrame, viewer: int, owner_column: str = "created_by") -> DataFrame:
    """Row scope from the viewer's role: admins see all, others their own rows.

    The role is a scalar subquery: it is looked up once and then is a constant
    in the filter, so the big table is neither joined nor shuffled.
    """
    role = users.filter(F.col("id") == viewer).agg(F.max("role").alias("role")).scalar()
    return df.filter((role == "Admin") | (F.col(owner_column) == viewer))


def month_bounds(month: str | dt.date) -> tuple[dt.date, dt.date]:
    """First day of the month and of the next one; '2024-1' equals '2024-01'."""
    if isinstance(month, dt.date):
        first = month.replace(day=1)
    else:
        year, number = (int(p) for p in month.split("-")[:2])
        first = dt.date(year, number, 1)
    following = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return first, following


def in_month(df: DataFrame, month: str | dt.date) -> DataFrame:
    """Calendar month as a half-open range: both bounds are pushed to the scan."""
    first, following = month_bounds(month)
    return df.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(following)))


def since(df: DataFrame, column: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    start = moment(as_of - dt.timedelta(days=days), df.schema[column].dataType)
    return df.filter(F.col(column) >= start)


def unread(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_read"))


def active(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_active"))


def by_id(df: DataFrame, key: int) -> DataFrame:
    return df.filter(F.col("id") == key)
