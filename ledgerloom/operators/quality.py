"""Data-quality profile: one row per check with the number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import KEY, ROLES


def _of_facts(facts: DataFrame, users: DataFrame) -> DataFrame:
    """One row with the four counts of the facts, which are read once.

    Grouping sets count rows per key and per owner; owners that no user has are marked by a
    join with one row per owner.
    """
    net = F.col("revenue") - F.col("cost") - F.col("expenses")
    gross = F.col("revenue") - F.col("cost")
    marked = facts.select(
        *KEY, "created_by", (F.col("profit") != net).cast("int").alias("net"), (F.col("profit") != gross).cast("int").alias("gross")
    )
    groups = marked.groupingSets([KEY, ["created_by"]], *KEY, "created_by").agg(
        F.grouping("created_by").alias("keyed"), F.count("*").alias("n"), F.sum("net").alias("net"), F.sum("gross").alias("gross")
    )
    known = users.select(F.col("id").alias("created_by"), F.lit(True).alias("known"))
    keyed = F.col("keyed") == 1
    orphan = ~keyed & F.col("created_by").isNotNull() & F.col("known").isNull()
    return groups.join(known, "created_by", "left").agg(
        F.sum(F.when(orphan, F.col("n"))).alias("business_data.created_by references users"),
        F.sum(F.when(keyed, F.col("n") - 1)).alias("business_data (date, department) is unique"),
        F.sum(F.when(keyed, F.col("net"))).alias("profit = revenue - cost - expenses"),
        F.sum(F.when(keyed, F.col("gross"))).alias("profit = revenue - cost"),
    )


def _of_uploads(history: DataFrame, users: DataFrame) -> DataFrame:
    """Uploads whose owner does not exist, counted per owner before the join."""
    owned = history.where("uploaded_by IS NOT NULL").groupBy(F.col("uploaded_by").alias("id")).agg(F.count("*").alias("n"))
    missing = owned.join(users.select("id"), "id", "left_anti")
    return missing.agg(F.sum("n").alias("upload_history.uploaded_by references users"))


def _of_users(users: DataFrame) -> DataFrame:
    """One row with the three counts of the users, in one pass."""
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("name", "email")]
    emails = users.groupBy(F.lower("email").alias("email")).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("role").isin(ROLES)).alias("unknown"),
        F.count_if(blank[0] | blank[1]).alias("blank"),
    )
    return emails.agg(
        F.sum(F.col("n") - 1).alias("users.email is unique ignoring case"),
        F.sum("unknown").alias("users.role is known"),
        F.sum("blank").alias("users.name and email are present"),
    )


def quality_checks(facts: DataFrame, users: DataFrame, history: DataFrame) -> DataFrame:
    """Every check with the number of rows that violate it. Facts and uploads are read once each."""
    out = None
    for counts in (_of_facts(facts, users), _of_uploads(history, users), _of_users(users)):
        listed = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias("violations")) for c in counts.columns]
        rows = counts.select(F.explode(F.array(*listed)).alias("c")).select("c.*")
        out = rows if out is None else out.unionByName(rows)
    return out
