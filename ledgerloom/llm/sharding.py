"""Contiguous shards of near-equal bytes, cut from global prefix sums.

1. One scan reduces every row to its key, its size in bytes and a checksum of its text.
2. These narrow rows are range-partitioned and sorted by (key, size, checksum, row number).
   The row number parts equal keys, so a key with a third of all rows still spreads over
   partitions.
3. Each partition's bytes and rows are added up. The prefix sums over these totals, one row
   per partition, say where in all bytes a partition starts; a running sum within
   the partition gives the place of every row.
4. The bytes are cut at equal targets: a row goes to the shard in which its middle byte lies.
   So shards are contiguous in that order, and each differs from its target by at most half a
   row at either end.

Only built-in functions and windows over one partition's rows are used; no window and no
task sees more than its share of rows, besides the list of partition totals.

Defined cases: a null text has no bytes, like an empty one, and checksum 0; null keys come
first; rows equal in key, size and checksum are taken in any order, which changes nothing but
which of them is which; equal texts may lie on both sides of a cut; a row larger than a target
leaves shards without rows; an empty table gives no rows. Other columns are
ignored unless carried along, in a struct of their own, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

SHARDS = 8
LAW = "bytes"


def sized(documents: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """(key, size, text_crc32, row) per row; ``row`` holds the carried columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col(key).alias("key"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(*[F.col(name) for name in carry]).alias("row") if carry else F.lit(None).cast("string").alias("row"),
    )


def _parts(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with their partition of the order and their place in it, written."""
    order = ["key", "size", "text_crc32", "number"]
    placed = (
        rows.withColumn("number", F.monotonically_increasing_id())
        .repartitionByRange(_parts(rows), *order)
        .sortWithinPartitions(*order)
        .drop("number")
    )
    return stored(
        placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ordered"
    )


def prefix_sums(totals: DataFrame) -> DataFrame:
    """(part, bytes_before, rows_before, all_bytes) from (part, bytes, rows): one row per partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )


def assign(documents: DataFrame, shards: int = SHARDS, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(key, size, text_crc32, row, shard, slot): the shard of every row and its place there."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = ordered(stored(sized(documents, key, carry or []), "sizes"))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # As many rows as there are partitions, whatever the input.
    starts = F.broadcast(prefix_sums(totals))
    up_to = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.repartitionByRange(_parts(rows), "part").select(
        "*", F.sum("size").over(up_to).alias("bytes_up_to"), F.count("*").over(up_to).alias("rows_up_to")
    )
    twice_middle = (2 * (F.col("bytes_before") + F.col("bytes_up_to")) - F.col("size")).cast("decimal(20,0)")
    shard = F.call_function("div", twice_middle * F.lit(shards), 2 * F.col("all_bytes")).cast("int")
    cut = stored(
        running.join(starts, "part").select(
            *["key", "size", "text_crc32", "row"],
            shard.alias("shard"),
            (F.col("rows_before") + F.col("rows_up_to") - 1).alias("at"),
        ),
        "cut",
    )
    first = F.broadcast(cut.groupBy("shard").agg(F.min("at").alias("first")))  # a row per shard
    return cut.join(first, "shard").select(
        "key", "size", "text_crc32", "row", "shard", (F.col("at") - F.col("first")).alias("slot")
    )


def write(documents: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", column: str = "shard") -> None:
    """Writes all rows and columns as Parquet folders ``column=0`` and so on, each in order of its slots."""
    if column in documents.columns:
        raise ValueError(f"documents have a column {column!r}; give another name")
    assigned = assign(documents, shards, key, documents.columns)
    # A shard is cut into as many files as tasks wrote; the sort keeps each in order.
    rows = assigned.repartitionByRange(max(shards, _parts(documents)), "shard", "slot")
    rows = rows.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(column))
    rows.write.partitionBy(column).parquet(folder)


def report(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    return assign(documents).select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
