"""Directories of uploaded CSV files: one pass over their text, headers, row numbers.

Lines are read once and written to the work folder with where they come from. What follows
reads that table: a row per file block, a row per file with its layout, and the typed rows.
Files may order their columns differently; every line is cut into as many fields as the
widest file has, and its file's layout says which field is which column. Nothing about files
or blocks is collected to the driver, besides the listing that Spark's own file index keeps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.headers import SEED_DEFAULTS, with_layout
from ledgerloom.operators.ingest import RAW, typed
from ledgerloom.sources.tables import metrics

# Admitted extensions. Workbooks are admitted but no reader for them
# exists here, so they are reported as failed.
READABLE = ["csv"]
WORKBOOKS = ["xlsx", "xls"]

# Up to this many file blocks are small enough to broadcast (about 200 bytes each);
# a longer list is joined by a shuffle.
BROADCAST_BLOCKS = 500_000

# A character that Java's trim, and so the CSV reader, does not take for blank.
INK = r"[^\x00-\x20]"

BY_SOURCE = ["source_no", "uri"]
BY_ARRIVAL = ["arrived", "uri"]
BY_NAME = ["uri"]


@dataclass(frozen=True)
class Staged:
    """The tables of one upload: ``rows`` of all usable files, and ``files``, a row per file."""

    rows: DataFrame
    files: DataFrame


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _extension() -> Column:
    return F.lower(F.regexp_extract("uri", r"\.([^./]*)$", 1))


def located(lines: DataFrame) -> DataFrame:
    """Lines that are not blank with their place: (uri, arrived, block_start, row, value).

    Rows of one block are consecutive in ``row``. Of files that are no CSV only lines of the
    first block stay, without their text, so that the file is known.
    """
    meta = lines.select(
        "*",
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    readable = _extension().isin(READABLE)
    inked = meta.filter(F.col("value").rlike(INK) & (readable | (F.col("block_start") == 0)))
    return inked.withColumn("row", F.monotonically_increasing_id()).withColumn("value", F.when(readable, F.col("value")))


def text_lines(spark: SparkSession, sources: list[str]) -> DataFrame:
    """The lines of all CSV files below the sources."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]")
    parts = [
        located(reader.text(_literal(source))).withColumn("source_no", F.lit(number))
        for number, source in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, parts)


def listing(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(source_no, uri, arrived) of every file below the sources; contents are not opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    parts = [
        reader.load(_literal(source)).select(
            F.lit(number).alias("source_no"),
            F.col("_metadata.file_path").alias("uri"),
            F.col("modificationTime").alias("arrived"),
        )
        for number, source in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, parts)


def _blocks(lines: DataFrame) -> DataFrame:
    """(source_no, uri, arrived, block_start, first_row, n): one row per file block, fixed-width sums."""
    return lines.groupBy("source_no", "uri", "arrived", "block_start").agg(
        F.min("row").alias("first_row"), F.count("*").alias("n")
    )


def _files(lines: DataFrame, blocks: DataFrame, listed: DataFrame | None, order: list[str], seed: bool) -> DataFrame:
    """One row per file: its ``part`` and ``place`` in the order, its first line's place, how many
    rows follow it, its layout or its problem.

    Files are ordered before their first lines are looked up, so that only a few numbers a file
    are sampled and moved.
    """
    heads = blocks.groupBy("source_no", "uri", "arrived").agg(
        F.min("block_start").alias("head_block"),
        F.min_by("first_row", "block_start").alias("head_row"),
        F.sum("n").alias("n_lines"),
    )
    if listed is not None:
        others = listed.join(heads.select("uri"), "uri", "left_anti")
        heads = heads.unionByName(others, allowMissingColumns=True)
    readable = _extension().isin(READABLE)
    ordered = (
        heads.withColumn("n_rows", F.when(readable & F.col("n_lines").isNotNull(), F.col("n_lines") - 1).otherwise(F.lit(0)))
        .drop("n_lines")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    )
    first = lines.select(
        "uri", F.col("block_start").alias("head_block"), F.col("row").alias("head_row"), F.col("value").alias("header")
    )
    found = ordered.join(first, ["uri", "head_block", "head_row"], "left")
    laid = with_layout(found, required=not seed).withColumn("extension", _extension())
    problem = (
        F.when(F.col("extension").isin(READABLE), F.col("problem"))
        .when(F.col("extension").isin(WORKBOOKS), F.lit("Excel workbooks cannot be read; upload CSV"))
        .otherwise(F.lit("Invalid file format. Please upload CSV or Excel file."))
    )
    name = F.regexp_extract("uri", r"([^/]*)$", 1)
    usable = F.col("problem").isNull()
    return laid.withColumn("problem", problem).select(
        "source_no",
        "uri",
        "arrived",
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("filename"),
        "problem",
        F.when(usable, F.col("width")).alias("width"),
        "at",
        "n_rows",
        "part",
        "place",
    )


def _numbered(ordered: DataFrame) -> DataFrame:
    """Adds ``file_no``, a file's place in the order, and ``rows_before``, the rows of all files before it.

    ``ordered`` was range-partitioned and sorted, and holds each row's ``part`` and ``place``
    there. Sums within a part and the sums of the parts before it give both numbers.
    """
    parts = ordered.groupBy("part").agg(F.count("*").alias("files"), F.sum("n_rows").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    zero = F.lit(0)
    starts = parts.select(
        "part",
        F.coalesce(F.sum("files").over(before), zero).alias("files_before"),
        F.coalesce(F.sum("rows").over(before), zero).alias("part_rows_before"),
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumn("_files", F.count("*").over(inside))
        .withColumn("_rows", F.coalesce(F.sum("n_rows").over(inside), zero))
        .join(F.broadcast(starts), "part")
        .withColumn("file_no", F.col("files_before") + F.col("_files"))
        .withColumn("rows_before", F.col("part_rows_before") + F.col("_rows"))
        .drop("part", "place", "files_before", "part_rows_before", "_files", "_rows")
    )


def _placed_blocks(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks of usable files, with what turns a line of theirs into a numbered row.

    ``row`` plus ``shift`` is a row's place in the batch, the header being the place before the
    file's first row.
    """
    inside = Window.partitionBy("uri").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    usable = files.where("problem IS NULL").drop("source_no", "arrived", "filename", "problem", "n_rows")
    joined = blocks.select("uri", "block_start", "first_row", "n").join(usable, "uri")
    earlier = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return joined.withColumn("shift", F.col("rows_before") + earlier - F.col("first_row") - 1).drop("first_row", "n")


def _parsed(lines: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Raw text rows (file_no, seq, malformed and the seven columns) of all usable files.

    A line with more fields than its header is malformed.
    """
    names = [f"c{i}" for i in range(width + 1)]
    schema = ", ".join(f"{name} string" for name in names)
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    rows = (
        lines.select("uri", "block_start", "row", "value")
        .join(places, ["uri", "block_start"])
        .withColumn("seq", F.col("row") + F.col("shift"))
        .where("seq >= rows_before")
    )
    fields = rows.select("file_no", "seq", "width", "at", F.from_csv("value", schema, options).alias("f"))
    cells = fields.select("file_no", "seq", "width", "at", F.array(*[F.col(f"f.{name}") for name in names]).alias("cells"))

    def cell(column: str) -> Column:
        at = F.col(f"at.{column}")
        return F.when(at.isNull(), F.lit(SEED_DEFAULTS.get(column)).cast("string")).otherwise(F.get("cells", at))

    return cells.select(
        "file_no", "seq", F.get("cells", F.col("width")).isNotNull().alias("malformed"), *[cell(c).alias(c) for c in RAW]
    )


def stage(
    spark: SparkSession, lines: DataFrame, work: str, seed: bool, order: list[str], listed: DataFrame | None = None
) -> Staged | None:
    """Writes an upload's tables to the work folder; None if there are no files.

    ``rows`` are typed, good candidates and certainly bad ones apart (``sound``). How many
    blocks there are and how wide the widest file is are observed while these are written.
    """
    lines.write.parquet(f"{work}/lines")
    read = spark.read.schema(lines.schema).parquet(f"{work}/lines")
    listed_blocks, found_files = Observation(), Observation()
    blocks = _blocks(read)
    blocks.observe(listed_blocks, F.count("*").alias("n")).write.parquet(f"{work}/blocks")
    blocks = spark.read.schema(blocks.schema).parquet(f"{work}/blocks")
    ordered = _files(read, blocks, listed, order, seed)
    ordered.observe(found_files, F.count("*").alias("n"), F.max("width").alias("width")).write.parquet(f"{work}/files")
    if not metrics(found_files, ordered).get("n"):
        return None
    numbered = _numbered(spark.read.schema(ordered.schema).parquet(f"{work}/files"))
    numbered.write.parquet(f"{work}/numbered")
    files = spark.read.schema(numbered.schema).parquet(f"{work}/numbered")
    places = _placed_blocks(blocks, files)
    small = metrics(listed_blocks, blocks).get("n", 0) <= BROADCAST_BLOCKS
    width = found_files.get["width"] or 0
    rows = typed(_parsed(read, F.broadcast(places) if small else places, width), seed)
    rows.write.partitionBy("sound").parquet(f"{work}/rows")
    return Staged(spark.read.schema(rows.schema).parquet(f"{work}/rows"), files)
