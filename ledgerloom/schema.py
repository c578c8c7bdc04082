"""Fixed schemas of the four business tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)

# Column names of an uploaded file and where each one goes.
UPLOAD_COLUMNS = {
    "Date": "date",
    "Revenue": "revenue",
    "Cost": "cost",
    "Profit": "profit",
    "Department": "department",
    "Expenses": "expenses",
    "Sales Volume": "sales_volume",
}

MEASURES = ["revenue", "cost", "expenses", "profit", "sales_volume"]
KEY = ["date", "department"]

BUSINESS_DATA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("revenue", MONEY),
        T.StructField("cost", MONEY),
        T.StructField("expenses", MONEY),
        T.StructField("profit", MONEY),
        T.StructField("department", T.StringType()),
        T.StructField("sales_volume", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_by", T.LongType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_login", T.TimestampType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("is_read", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

UPLOAD_HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("records_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("uploaded_by", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Domains and defaults.
ROLES = ["Admin", "Business Manager", "Analyst"]
SEVERITIES = ["info", "warning", "danger"]
UPLOAD_STATUSES = ["success", "failed", "partial"]
REVENUE_DROP_THRESHOLD = 10
PROFIT_MARGIN_THRESHOLD = 10
ITEMS_PER_PAGE = 50
