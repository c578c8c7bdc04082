"""What several operators of this package need: stored tables, row keys, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared work folder and read it back.

    This cuts the lineage at files every executor can read, so a lost executor costs
    no more than its running tasks, and what follows does not compute the frame again.
    """
    spark = frame.sparkSession
    folder = work_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays, unlike with lower()."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def broadcast_up_to(frame: DataFrame, rows: int) -> DataFrame:
    """The frame, with a broadcast hint only if it was counted and is that small."""
    return F.broadcast(frame) if frame.count() <= rows else frame
