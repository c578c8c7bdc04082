"""The four business tables derived from the order-and-event tables.

``business_data`` groups line items by ship date and order priority, ``users``
are the suppliers, uploads and alerts come from the events. Inputs are cast to
DECIMAL before any arithmetic so that sums are exact and independent of order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import MONEY
from ledgerloom.sources.tables import table

# The five order priorities, which act as departments.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Sums per (date, priority) get room to grow with the input.
TOTAL = T.DecimalType(25, 2)


def _hundredths(column: str) -> Column:
    """A two-decimal amount as a whole number of hundredths.

    Exact like a decimal, but every step of the hot loop stays a primitive long;
    overflow is an error in ANSI mode, not a wrong result.
    """
    return F.floor(F.col(column) * 100 + 0.5)


def _rounded_hundredths(scaled: str) -> Column:
    """Ten-thousandths to hundredths, halves away from zero."""
    return F.expr(f"({scaled} + if({scaled} < 0, -50, 50)) div 100")


def _amount(hundredths: str) -> Column:
    return (F.col(hundredths).cast("decimal(23,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(TOTAL).alias(hundredths)


def business_data(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (ship date, priority).

    Both joins are plain equi-joins: Spark broadcasts a side it has measured to
    be small and otherwise sorts and merges, splitting hot keys at run time. The
    aggregation combines before its shuffle, so a hot date or priority does
    not concentrate rows.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        _hundredths("l_extendedprice").alias("price"),
        (100 - _hundredths("l_discount")).alias("paid"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("department"))
    parts = table(spark, folder, "part").select("p_partkey", _hundredths("p_retailprice").alias("unit_cost"))

    digit = F.substring("department", 1, 1).cast("bigint")
    rows = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "date",
            "department",
            "quantity",
            "l_suppkey",
            (F.col("price") * F.col("paid")).alias("discounted"),
            (F.col("unit_cost") * F.col("quantity")).alias("cost"),
            (F.col("price") * 9 * digit * digit).alias("overhead"),
        )
    )
    totals = rows.groupBy("date", "department").agg(
        F.sum(_rounded_hundredths("discounted")).alias("revenue"),
        F.sum("cost").alias("cost"),
        F.sum(_rounded_hundredths("overhead")).alias("expenses"),
        F.sum("quantity").alias("sales_volume"),
        F.min("l_suppkey").alias("created_by"),
    )
    amounts = totals.select(
        "date", "department", "sales_volume", "created_by", *[_amount(c) for c in ("revenue", "cost", "expenses")]
    )
    return amounts.select(
        (F.unix_date("date").cast("bigint") * 10 + digit).alias("id"),
        "date",
        "revenue",
        "cost",
        "expenses",
        (F.col("revenue") - F.col("cost") - F.col("expenses")).cast(TOTAL).alias("profit"),
        "department",
        "sales_volume",
        F.col("date").cast("timestamp_ntz").alias("created_at"),
        "created_by",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    logins = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("login_user"))
        .agg(F.max("ts").alias("last_login"))
    )
    key = F.col("s_suppkey")
    role = F.when(key % 10 == 0, "Admin").when(key % 3 == 0, "Business Manager").otherwise("Analyst")
    return (
        table(spark, folder, "supplier")
        .join(logins, key == F.col("login_user"), "left")
        .select(
            key.alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
            role.alias("role"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
            "last_login",
        )
    )


def order_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a typed upload row: it meets the keys of ``business_data``,
    and several orders meet on one key."""
    total = F.col("o_totalprice").cast(MONEY)
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("file_no"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("date").alias("date"),
        total.alias("revenue"),
        F.round(total / 2, 2).cast(MONEY).alias("cost"),
        F.lit("10.00").cast(MONEY).alias("expenses"),
        F.round(total / 4, 2).cast(MONEY).alias("profit"),
        F.col("o_orderpriority").alias("department"),
        F.col("o_custkey").alias("sales_volume"),
    )


def record_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an edit of the record with its date and priority: status F sets
    the revenue, O the cost, P moves the record to the next day."""
    day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    total = F.col("o_totalprice").cast(MONEY)
    nothing = F.lit(None)
    return table(spark, folder, "orders").select(
        (F.unix_date(day).cast("bigint") * 10 + digit).alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.when(status == "P", F.date_add(day, 1)).alias("date"),
        F.when(status == "F", total).alias("revenue"),
        F.when(status == "O", total).alias("cost"),
        nothing.cast(MONEY).alias("expenses"),
        nothing.cast(MONEY).alias("profit"),
        nothing.cast("string").alias("department"),
        nothing.cast("bigint").alias("sales_volume"),
    )


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an edit of its user."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", F.concat(F.lit("User "), F.col("event_id").cast("string"))).alias("name"),
        F.when(kind == "signup", "Business Manager").when(kind == "purchase", "Admin").alias("role"),
        F.when(kind == "error", False).when(kind == "view", True).alias("is_active"),
    )


def _by_event_type(values: dict[str, str], otherwise: str) -> Column:
    chain = None
    for event_type, value in values.items():
        hit = F.col("event_type") == event_type
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(otherwise)


def upload_history(spark: SparkSession, folder: str) -> DataFrame:
    status = _by_event_type({"error": "failed", "click": "partial"}, "success")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("file_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("filename"),
        F.floor("value").cast("bigint").alias("records_count"),
        status.alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("user_id").alias("uploaded_by"),
        F.col("ts").alias("created_at"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an existing alert.

    Clicks name the first three priorities and views the first four, so some
    department alerts are already open and others are not.
    """
    kind = _by_event_type(
        {"error": "revenue_drop", "click": "low_margin", "view": "expense_exceed", "signup": "growth_alert"},
        "revenue_milestone",
    )
    severity = _by_event_type({"error": "danger", "click": "warning", "view": "danger"}, "info")
    user = F.col("user_id")
    spread = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 4).otherwise(5)
    named = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (user % spread + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        kind.alias("type"),
        F.concat(kind, F.lit(" #"), F.col("event_id").cast("string")).alias("message"),
        severity.alias("severity"),
        F.when(F.col("event_type") != "error", named).alias("department"),
        (user % 2 == 0).alias("is_read"),
        F.col("ts").alias("created_at"),
    )


def raw_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a line of an uploaded file, all fields text, some damaged.

    The event number modulo 50 decides the damage: 0 an impossible date; 1, 2, 3
    and 6 a revenue that is no number; 4 and 5 a bad and a fractional sales
    volume; 7 and 8 a blank and a padded department. The file is the day. Views
    earn little and errors spend much, so both department alert rules fire.
    """
    event, damage = F.col("event_id"), F.col("event_id") % 50
    day = F.date_format("ts", "yyyy-MM-dd")
    value, kind = F.col("value").cast(MONEY), F.col("event_type")
    amount = value.cast("string")
    slim = F.round(value * F.lit("0.05").cast("decimal(4,2)"), 2).cast(MONEY).cast("string")
    return table(spark, folder, "events").select(
        F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("file_no"),
        F.concat(F.lit("uploads_"), day, F.lit(".csv")).alias("filename"),
        event.alias("seq"),
        event.alias("line"),
        F.when(damage == 0, "2024-13-01").otherwise(day).alias("date"),
        F.when(damage == 1, "x")
        .when(damage == 2, "1,000")
        .when(damage == 3, "inf")
        .when(damage == 6, "")
        .otherwise(amount)
        .alias("revenue"),
        F.col("user_id").cast("string").alias("cost"),
        F.when(kind == "error", F.col("user_id") * 10).otherwise(event % 7).cast("string").alias("expenses"),
        F.when(kind == "view", slim).otherwise(amount).alias("profit"),
        F.when(damage == 7, "  ").when(damage == 8, F.concat(F.lit("  "), kind, F.lit(" "))).otherwise(kind).alias("department"),
        F.when(damage == 4, "abc").when(damage == 5, "12.7").otherwise(F.col("user_id").cast("string")).alias("sales_volume"),
    )


def dated_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The raw uploads dealt to 97 files that write their dates in different forms.

    The file number modulo 5 decides the form: 0 year first, 1 day first, 2 month first, 3 either
    of these two from line to line, 4 month first on the first days of the month only, and the
    name of the month on others.
    """
    raw = raw_uploads(spark, folder)
    file_no = F.col("seq") % 97
    day = F.col("date").try_cast("date")
    form = file_no % 5
    by_day, by_month = F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "MM/dd/yyyy")
    text = (
        F.when(day.isNull() | (form == 0), F.col("date"))
        .when(form == 1, by_day)
        .when(form == 2, by_month)
        .when(form == 3, F.when(F.floor(F.col("seq") / 97) % 2 == 0, by_day).otherwise(by_month))
        .otherwise(F.when(F.dayofmonth(day) <= 12, by_month).otherwise(F.date_format(day, "d MMM yyyy")))
    )
    name = F.concat(F.lit("dated_"), file_no.cast("string"), F.lit(".csv"))
    return raw.withColumn("date", text).withColumn("file_no", file_no).withColumn("filename", name)
