"""User activity, statistics, row security for all viewers, owner lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import iso
from ledgerloom.functions.measures import moment


def user_activity(users: DataFrame, history: DataFrame, facts: DataFrame) -> DataFrame:
    """Uploads and records per user.

    Each child is counted per user before it is joined: joining both children
    first would multiply the two counts, and a hot user's rows with them.
    """
    uploads = history.groupBy(F.col("uploaded_by").alias("u_user")).agg(F.count("*").alias("upload_count"))
    records = facts.groupBy(F.col("created_by").alias("r_user")).agg(F.count("*").alias("data_records"))
    return (
        users.join(uploads, F.col("id") == F.col("u_user"), "left")
        .join(records, F.col("id") == F.col("r_user"), "left")
        .select(
            F.col("id").alias("user_id"),
            "name",
            "email",
            "role",
            iso(F.col("last_login")).alias("last_login"),
            F.coalesce("upload_count", F.lit(0)).alias("upload_count"),
            F.coalesce("data_records", F.lit(0)).alias("data_records"),
        )
    )


def statistics(users: DataFrame, history: DataFrame, facts: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Six counts as one row.

    Every table is reduced to one row on its own; the rows are stacked and added
    up, so no table is joined to another.
    """
    start = as_of - dt.timedelta(days=days)
    login_from = moment(start, users.schema["last_login"].dataType)
    upload_from = moment(start, history.schema["created_at"].dataType)
    zero = F.lit(0).cast("bigint")
    names = [
        "total_users",
        "active_users",
        "total_data_records",
        "total_uploads",
        "recent_uploads_7days",
        "recent_logins_7days",
    ]
    counted = [
        users.agg(
            F.count("*").alias("total_users"),
            F.count_if(F.col("is_active")).alias("active_users"),
            F.count_if(F.col("last_login") >= login_from).alias("recent_logins_7days"),
        ),
        facts.agg(F.count("*").alias("total_data_records")),
        history.agg(
            F.count("*").alias("total_uploads"),
            F.count_if(F.col("created_at") >= upload_from).alias("recent_uploads_7days"),
        ),
    ]
    stacked = None
    for part in counted:
        row = part.select(*[F.col(n) if n in part.columns else zero.alias(n) for n in names])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def owner_scoped_totals(users: DataFrame, facts: DataFrame) -> DataFrame:
    """What each viewer sees in total: admins everything, others their own rows.

    The fact table is summed once per owner. The grand total is a scalar subquery
    over those sums; nothing is repeated per viewer.
    """
    own = facts.groupBy("created_by").agg(
        F.count("*").alias("records"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    everything = own.agg(
        F.struct(
            F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("revenue"),
            F.coalesce(F.sum("profit"), F.lit(0)).cast("double").alias("profit"),
        ).alias("all")
    ).scalar()
    mine = F.struct(
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("revenue", F.lit(0)).cast("double").alias("revenue"),
        F.coalesce("profit", F.lit(0)).cast("double").alias("profit"),
    )
    seen = users.join(own, F.col("id") == F.col("created_by"), "left").select(
        F.col("id").alias("viewer"), "role", F.when(F.col("role") == "Admin", everything).otherwise(mine).alias("seen")
    )
    return seen.select(
        "viewer",
        "role",
        F.col("seen.records").alias("visible_records"),
        F.col("seen.revenue").alias("visible_revenue"),
        F.col("seen.profit").alias("visible_profit"),
    )


def with_owner(df: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """Adds the owner's name and role; rows without a known owner keep NULLs.

    Users are projected to three columns. Spark broadcasts them when it measures
    them small and otherwise merges, splitting the partitions of hot owners.
    """
    owners = users.select(
        F.col("id").alias("_owner"), F.col("name").alias("owner_name"), F.col("role").alias("owner_role")
    )
    return df.join(owners, F.col(column) == F.col("_owner"), "left").drop("_owner")


def totals_by_role(df: DataFrame, users: DataFrame) -> DataFrame:
    """Records and revenue per role of the creator.

    Summed per owner first, so the join carries one row per owner, not per record.
    """
    own = df.groupBy("created_by").agg(F.count("*").alias("records"), F.sum("revenue").alias("revenue"))
    return (
        with_owner(own, users, "created_by")
        .groupBy(F.coalesce("owner_role", F.lit("none")).alias("role"))
        .agg(F.sum("records").alias("records"), F.sum("revenue").cast("double").alias("revenue"))
    )
