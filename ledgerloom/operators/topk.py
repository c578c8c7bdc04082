"""Top-k selections that keep hot keys out of a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column) -> DataFrame:
    """First ``k`` rows of every key in the given total order.

    Two rankings: first inside (key, salt), then inside the key. Spark limits each
    map task to k rows per window partition before it shuffles, and the salt
    spreads what remains of a hot key over SALTS tasks, so the final ranking sees
    at most SALTS * k rows of any key. ``spread`` is a column that differs between
    rows of one key, usually the row's id.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(inner))
        .filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(outer))
        .filter(F.col("_rank") <= k)
        .drop("_rank", "_salt")
    )
