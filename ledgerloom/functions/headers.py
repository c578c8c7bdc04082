"""Header lines of uploaded files: which column lies where, or why a file cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.coercion import stripped
from ledgerloom.schema import UPLOAD_COLUMNS

# Accepted spellings, after trimming and title-casing.
ALIASES = {
    "Sales_Volume": "Sales Volume",
    "Salesvolume": "Sales Volume",
    "Sales": "Sales Volume",
}

# What a column that a seed file lacks is read as.
SEED_DEFAULTS = {
    "revenue": "0",
    "cost": "0",
    "profit": "0",
    "expenses": "0",
    "sales_volume": "0",
    "department": "Unknown",
}

NO_COLUMNS = "No columns to parse from file"

# A field and the comma after it; quoted fields may hold commas.
_FIELD = r'("(?:[^"]|"")*"[^,]*|[^,]*),'


def normalise(name: str) -> str:
    """Trimmed, title-cased, alias resolved."""
    titled = name.replace("﻿", "").strip().title()
    return ALIASES.get(titled, titled)


def _known() -> dict[str, str]:
    """Accepted names in lower case, and the column each one stands for."""
    titles = {title.lower(): column for title, column in UPLOAD_COLUMNS.items()}
    return titles | {alias.lower(): UPLOAD_COLUMNS[title] for alias, title in ALIASES.items()}


def fields(line: Column) -> Column:
    """The fields of a header line, without their quotes."""
    whole = F.regexp_extract_all(F.concat(F.regexp_replace(line, "﻿", ""), F.lit(",")), F.lit(_FIELD), F.lit(1))
    quoted = r'^"((?:[^"]|"")*)"(.*)$'
    return F.transform(
        whole,
        lambda x: F.when(
            x.startswith('"'), F.concat(F.replace(F.regexp_extract(x, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, quoted, 2))
        ).otherwise(x),
    )


def with_layout(files: DataFrame, required: bool = True) -> DataFrame:
    """Adds to files with a ``header`` line their ``problem``, ``width`` and the position ``at`` of every column.

    The same name written twice keeps its first position. Two different names for one column
    are ambiguous. With ``required=False`` (seed files) columns may be missing: their
    position is null.
    """
    known = F.create_map(*[F.lit(text) for pair in _known().items() for text in pair])
    columns = F.transform("_names", lambda x: F.element_at(known, F.lower(stripped(x))))
    read = files.withColumn("_names", fields(F.col("header"))).withColumn("_columns", columns)

    def spelled_twice(column: str) -> Column:
        own = F.filter("_names", lambda x, i: F.get("_columns", i) == column)
        return F.size(F.array_distinct(own)) > 1

    titles = {column: title for title, column in UPLOAD_COLUMNS.items()}
    places = [(F.nullif(F.array_position("_columns", c), F.lit(0)) - 1).cast("int").alias(c) for c in titles]
    ambiguous = F.coalesce(*[F.when(spelled_twice(c), F.lit(title)) for c, title in titles.items()])
    missing = F.array_except(F.array(*map(F.lit, titles.values())), F.transform("_columns", _title_of(titles)))
    problem = F.when(F.col("header").isNull() | (stripped(F.col("header")) == ""), F.lit(NO_COLUMNS)).when(
        F.col("_ambiguous").isNotNull(), F.concat(F.lit("Ambiguous columns for "), F.col("_ambiguous"))
    )
    if required:
        problem = problem.when(
            F.size("_missing") > 0, F.concat(F.lit("Missing required columns: "), F.array_join("_missing", ", "))
        )
    found = read.withColumns({"_ambiguous": ambiguous, "_missing": missing, "at": F.struct(*places), "width": F.size("_names")})
    return found.withColumn("problem", problem).drop("_names", "_columns", "_ambiguous", "_missing")


def _title_of(titles: dict[str, str]):
    spelled = F.create_map(*[F.lit(text) for pair in titles.items() for text in pair])
    return lambda column: F.element_at(spelled, column)
