"""Behaviour at scale, shown on small data: hot keys and no broadcasting."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import admin
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.sources import adapter
from tools.compare import canonical

from paths import SMALL

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "6",
}


@pytest.fixture()
def large(spark):
    """Settings under which small data takes the paths that large data takes."""
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


NAMES = [
    "kpi_summary", "monthly_summary_departments", "user_activity", "owner_scoped_totals", "alerts_new",
    "upsert_last_wins", "insert_if_absent", "updates_applied", "users_removed", "uploads_with_owner",
    "user_recent_records", "alerts_mark_read", "quality_checks", "ingest_file_status",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_without_small_tables(spark, large, name):
    """Merge joins instead of broadcasts: same result, and still no nested loops."""
    plan = QUERIES[name](large, SMALL)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    rows = canonical(plan.toPandas())
    for key in LARGE:
        spark.conf.unset(key)
    assert rows == canonical(QUERIES[name](spark, SMALL).toPandas())


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Input tables in which one order, one part and one user hold most rows."""
    folder = tmp_path_factory.mktemp("skewed")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    hot = F.col("l_linenumber") != 3
    many = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5)))).drop("copy")
    (
        many.withColumn("l_orderkey", F.when(hot, 7).otherwise(F.col("l_orderkey")))
        .withColumn("l_partkey", F.when(hot, 5).otherwise(F.col("l_partkey")))
        .repartition(12)
        .write.parquet(f"{folder}/lineitem.parquet")
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(5)))
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("copy", copies)
    (
        events.withColumn("user_id", F.when(F.col("event_id") % 4 > 0, 3).otherwise(F.col("user_id")))
        .withColumn("event_id", F.col("event_id") * 6 + F.col("copy"))
        .drop("copy")
        .repartition(12)
        .write.parquet(f"{folder}/events.parquet")
    )
    for name in ("orders", "part", "supplier"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_hot_join_keys_are_split(spark, large, skewed):
    """The join partition of the hot key is split over several tasks."""
    facts = adapter.business_data(large, skewed)
    assert "skew=true" in final_plan(facts)
    rows = canonical(facts.toPandas())
    for key in LARGE:
        spark.conf.unset(key)
    assert rows == canonical(adapter.business_data(spark, skewed).toPandas())


def test_hot_owner_lookup_is_split(spark, large, skewed):
    joined = admin.with_owner(adapter.upload_history(large, skewed), adapter.users(large, skewed), "uploaded_by")
    assert "skew=true" in final_plan(joined.select("id", "filename", "status", "created_at", "owner_name"))
    assert joined.count() == adapter.upload_history(large, skewed).count()
