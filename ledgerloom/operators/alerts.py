"""Alert rules and suppression of repeats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import growth, moment, percent_of
from ledgerloom.operators.filters import unread
from ledgerloom.operators.rollup import monthly_departmental
from ledgerloom.schema import PROFIT_MARGIN_THRESHOLD, REVENUE_DROP_THRESHOLD


def evaluate(
    df: DataFrame,
    margin_threshold: float = PROFIT_MARGIN_THRESHOLD,
    drop_threshold: float = REVENUE_DROP_THRESHOLD,
) -> DataFrame:
    """All alerts the rules raise on the given records: type, message, severity,
    department and the unrounded value that fired.

    The records are read once: they are condensed per month and department, and grouping sets
    of these cells give the departments' and the months' totals.
    """
    cells = monthly_departmental(df)
    totals = cells.groupingSets([["month"], ["department"]], "month", "department").agg(
        F.grouping("month").alias("departmental"), *[F.sum(c).alias(c) for c in ("revenue", "profit", "expenses")]
    )
    # A row per department, and one with all months, of which the calendar has few.
    whole = F.when(F.col("departmental") == 0, F.struct("month", "revenue"))
    rows = totals.groupBy("departmental", "department").agg(
        *[F.max(F.when(F.col("departmental") == 1, F.col(c))).alias(c) for c in ("revenue", "profit", "expenses")],
        F.array_sort(F.collect_list(whole)).alias("months"),
    )
    margin = F.when(F.col("revenue") > 0, percent_of(F.col("profit"), F.col("revenue"))).otherwise(F.lit(0.0))
    latest, previous = (F.get(F.col("months.revenue"), F.size("months") - back) for back in (1, 2))
    drop = -growth(latest, F.when(F.size("months") > 1, previous))
    rules = {
        "low_margin": (
            (F.col("departmental") == 1) & (margin < margin_threshold),
            F.concat(
                F.lit("Low profit margin ("), F.format_string("%.1f", margin), F.lit("%) detected in "), F.col("department")
            ),
            "warning",
            margin,
        ),
        "expense_exceed": (
            F.col("expenses") > F.col("revenue"),
            F.concat(F.lit("Expenses exceed revenue in "), F.col("department"), F.lit("!")),
            "danger",
            (F.col("expenses") - F.col("revenue")).cast("double"),
        ),
        "revenue_drop": (
            drop > drop_threshold,
            F.concat(F.lit("Revenue dropped by "), F.format_string("%.1f", drop), F.lit("% compared to last month")),
            "danger",
            drop,
        ),
    }
    fired = [
        F.when(
            fires,
            F.struct(F.lit(kind).alias("type"), message.alias("message"), F.lit(severity).alias("severity"), value.alias("value")),
        )
        for kind, (fires, message, severity, value) in rules.items()
    ]
    return rows.select("department", F.explode(F.array_compact(F.array(*fired))).alias("alert")).select(
        "alert.type", "alert.message", "alert.severity", "department", "alert.value"
    )


def suppress(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without an open (unread) alert of the same type and department.

    A revenue drop is matched on its type only. Open alerts are reduced to their
    distinct keys before the join, however often one of them was raised. An outer
    join is used because an anti join would be pushed below the union of the rules,
    where the constant type leaves no key to join on.
    """
    whole_company = F.col("type") == "revenue_drop"
    open_keys = (
        unread(existing)
        .select(
            F.col("type").alias("open_type"),
            F.when(~whole_company, F.col("department")).alias("open_department"),
        )
        .distinct()
    )
    same = (F.col("type") == F.col("open_type")) & F.col("department").eqNullSafe(F.col("open_department"))
    matched = candidates.join(open_keys, same, "left")
    return matched.filter(F.col("open_type").isNull()).drop("open_type", "open_department")


def new_alerts(df: DataFrame, existing: DataFrame, created_at: dt.datetime, **thresholds) -> DataFrame:
    """Alert rows to append. The id is a positive hash of what identifies the alert:
    its type, its department and the moment it was raised."""
    raised = suppress(evaluate(df, **thresholds), existing)
    raised_at = moment(created_at)
    identity = F.xxhash64("type", F.coalesce("department", F.lit("")), raised_at)
    return raised.select(
        identity.bitwiseAND(F.lit(2**63 - 1)).alias("id"),
        "type",
        "message",
        "severity",
        "department",
        F.lit(False).alias("is_read"),
        raised_at.alias("created_at"),
    )


def mark_read(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets is_read on the alerts whose id is listed."""
    hits = ids.select(F.col("id").alias("_hit")).distinct()
    joined = alerts.join(hits, F.col("id") == F.col("_hit"), "left")
    return joined.withColumn("is_read", F.col("is_read") | F.col("_hit").isNotNull()).drop("_hit")


def mark_all_read(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("is_read", F.lit(True))
