"""Listings: pages, latest rows, per-user recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.display import file_kind, iso, iso_date, status_icon, status_label
from ledgerloom.functions.measures import as_double, margin
from ledgerloom.operators.filters import Scope, unread
from ledgerloom.operators.topk import top_k_per_key
from ledgerloom.schema import ITEMS_PER_PAGE

MAX_PER_PAGE = 100


def record_projection(df: DataFrame) -> DataFrame:
    """Records as they are shown: ISO texts, row margin."""
    return df.select(
        "id",
        iso_date(F.col("date")).alias("date"),
        *as_double("revenue", "cost", "expenses", "profit"),
        "department",
        "sales_volume",
        iso(F.col("created_at")).alias("created_at"),
        "created_by",
        margin(F.col("profit"), F.col("revenue")).alias("row_margin"),
    )


def _page_size(per_page: int, most: int) -> int:
    return max(1, min(per_page, most))


def records_page(
    df: DataFrame,
    page: int = 1,
    per_page: int = ITEMS_PER_PAGE,
    scope: Scope = Scope(),
    max_per_page: int = MAX_PER_PAGE,
) -> DataFrame:
    """One page, newest date first; never more than ``max_per_page`` rows.

    Counts per date say on which dates the page lies, so however deep it is, only the
    rows of these dates are ordered, as a top-k that skips at most what precedes the page
    on its first date.
    """
    size = _page_size(per_page, max_per_page)
    scoped, skipped = scope.apply(df), (max(page, 1) - 1) * size
    if skipped:
        counts = scoped.groupBy("date").agg(F.count("*").alias("rows"))
        # One row per calendar day that has records.
        through = F.sum("rows").over(Window.orderBy(F.col("date").desc()))
        placed = counts.withColumn("through", through).withColumn("before", F.col("through") - F.col("rows"))
        on_page = placed.filter((F.col("through") > skipped) & (F.col("before") < skipped + size))
        found = on_page.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("before").alias("before"))
        bounds = found.first()
        if bounds["before"] is None:  # past the last page
            return record_projection(scoped.limit(0))
        scoped = scoped.filter(F.col("date").between(F.lit(bounds["first"]), F.lit(bounds["last"])))
        skipped -= bounds["before"]
    ordered = scoped.orderBy(F.col("date").desc(), "department", "id")
    return record_projection(ordered.offset(skipped).limit(size))


def records_after(
    df: DataFrame,
    date: str,
    department: str,
    per_page: int = ITEMS_PER_PAGE,
    scope: Scope = Scope(),
    max_per_page: int = MAX_PER_PAGE,
) -> DataFrame:
    """The page that follows a given last row. Its cost does not grow with the
    depth: earlier rows are filtered at the scan instead of skipped after a sort."""
    last = F.lit(date).cast("date")
    later = scope.apply(df).filter(
        (F.col("date") <= last) & ((F.col("date") < last) | (F.col("department") > department))
    )
    return record_projection(later.orderBy(F.col("date").desc(), "department", "id").limit(_page_size(per_page, max_per_page)))


def page_info(
    df: DataFrame,
    page: int = 1,
    per_page: int = ITEMS_PER_PAGE,
    scope: Scope = Scope(),
    max_per_page: int = MAX_PER_PAGE,
) -> DataFrame:
    size = _page_size(per_page, max_per_page)
    return scope.apply(df).agg(F.count("*").alias("total")).select(
        "total",
        F.ceil(F.col("total") / size).cast("bigint").alias("pages"),
        F.lit(max(page, 1)).cast("bigint").alias("current_page"),
    )


def alert_projection(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "type", "message", "severity", "department", "is_read", iso(F.col("created_at")).alias("created_at")
    )


def latest_alerts(alerts: DataFrame, unread_only: bool = False, limit: int = 100) -> DataFrame:
    rows = unread(alerts) if unread_only else alerts
    return alert_projection(rows.orderBy(F.col("created_at").desc(), "id").limit(limit))


def unread_count(alerts: DataFrame) -> DataFrame:
    return unread(alerts).agg(F.count("*").alias("unread"))


def upload_projection(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "filename",
        "records_count",
        "status",
        "error_message",
        "uploaded_by",
        iso(F.col("created_at")).alias("created_at"),
        status_label(F.col("status")).alias("status_label"),
        status_icon(F.col("status")).alias("status_icon"),
        file_kind(F.col("filename")).alias("file_kind"),
    )


def latest_uploads(history: DataFrame, limit: int = 50) -> DataFrame:
    return upload_projection(history.orderBy(F.col("created_at").desc(), "id").limit(limit))


def upload_status_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("status").agg(
        F.count("*").alias("uploads"), F.sum("records_count").cast("bigint").alias("records")
    )


def recent_records_per_user(df: DataFrame, limit: int = 100) -> DataFrame:
    """Every user's latest records."""
    owned = df.filter(F.col("created_by").isNotNull())
    order = [F.col("date").desc(), F.col("department"), F.col("id")]
    return record_projection(top_k_per_key(owned, ["created_by"], order, limit, F.col("id")))


def recent_uploads_per_user(history: DataFrame, limit: int = 20) -> DataFrame:
    """Every user's latest uploads."""
    owned = history.filter(F.col("uploaded_by").isNotNull())
    order = [F.col("created_at").desc(), F.col("id")]
    return upload_projection(top_k_per_key(owned, ["uploaded_by"], order, limit, F.col("id")))


def recent_records_of(df: DataFrame, user_id: int, limit: int = 100) -> DataFrame:
    rows = df.filter(F.col("created_by") == user_id)
    return record_projection(rows.orderBy(F.col("date").desc(), "department", "id").limit(limit))


def recent_uploads_of(history: DataFrame, user_id: int, limit: int = 20) -> DataFrame:
    rows = history.filter(F.col("uploaded_by") == user_id)
    return upload_projection(rows.orderBy(F.col("created_at").desc(), "id").limit(limit))


def user_projection(users: DataFrame) -> DataFrame:
    return users.select(
        "id",
        "name",
        "email",
        "role",
        "is_active",
        iso(F.col("created_at")).alias("created_at"),
        iso(F.col("last_login")).alias("last_login"),
    )
