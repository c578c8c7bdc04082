"""Session settings every job relies on, and the shared work folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings; each can be set on a session somebody else created.
SETTINGS = {
    # Timestamps are UTC throughout, also "now minus seven days".
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: coalesce small shuffle partitions, split skewed ones,
    # and pick broadcast joins from measured instead of estimated sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a hot join key is worth the extra exchange it may add.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Good and bad rows of an upload are written side by side without a sort.
    "spark.sql.maxConcurrentOutputFileWriters": "2",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        # No call-site bookkeeping for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder for written intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, or else
    in the warehouse, which executors share as well; never in a machine's own folder: off
    one machine a warehouse on a local path is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        if not one_machine and re.match(r"(file:|/|[^:]*$)", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse}/_work"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
