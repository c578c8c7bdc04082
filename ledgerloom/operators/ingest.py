"""Row validation and the per-file outcome of an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coercion
from ledgerloom.operators.topk import top_k_per_key
from ledgerloom.schema import KEY, MEASURES

RAW = ["date", "revenue", "cost", "expenses", "profit", "department", "sales_volume"]


def _problem(typed: Column, raw: Column, what: str) -> Column:
    shown = F.coalesce(raw, F.lit(""))
    return F.when(typed.isNull(), F.concat(F.lit(f"invalid {what} '"), shown, F.lit("'")))


def typed(raw: DataFrame, seed: bool = False) -> DataFrame:
    """Types the seven text columns, as far as one row alone can say.

    Where a date could be read month or day first, ``date`` is read month first, ``day_first``
    is the other reading and ``open_order`` is true. ``problems`` lists what is wrong besides the
    date, ``texts`` keeps the fields of a row that is or may become bad, ``sound`` says that it
    can be good. A column ``malformed`` that is true marks a line with more fields than its header.
    """
    strict = coercion.strict_date(F.col("date"))
    date, day_first, open_order = (strict, F.lit(None).cast("date"), F.lit(False)) if seed else coercion.date_readings(F.col("date"))
    whole_number = coercion.strict_whole_number if seed else coercion.whole_number
    fields = {
        **{c: coercion.money(F.col(c)) for c in ("revenue", "cost", "expenses", "profit")},
        "department": coercion.department(F.col("department")),
        "sales_volume": whole_number(F.col("sales_volume")),
    }
    kept = [c for c in raw.columns if c not in RAW and c != "malformed"]
    staged = raw.select(
        *kept,
        F.col("malformed") if "malformed" in raw.columns else F.lit(False).alias("malformed"),
        F.struct(*RAW).alias("_raw"),
        date.alias("date"),
        day_first.alias("day_first"),
        open_order.alias("open_order"),
        *[expression.alias(name) for name, expression in fields.items()],
    )
    problems = [_problem(F.col(c), F.col(f"_raw.{c}"), c.replace("_", " ")) for c in RAW if c != "date"]
    problems.append(F.when(F.col("malformed"), F.lit("more fields than columns")))
    complete = ~F.col("malformed")
    for c in fields:
        complete = complete & F.col(c).isNotNull()
    readable = F.col("date").isNotNull() | F.col("day_first").isNotNull()
    return (
        staged.withColumn("sound", complete & readable)
        .withColumn(
            "problems", F.when(complete, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*problems)))
        )
        .withColumn("texts", F.when(~F.col("sound") | F.col("open_order"), F.col("_raw")))
        .drop("_raw", "malformed")
    )


def date_orders(rows: DataFrame) -> DataFrame:
    """(file_no, orders) of files that have dates of numbers alone: 1 if all of them can be read
    month first, plus 2 if all can be read day first.

    Cells that are no date in either order say nothing. One aggregate with a fixed-width
    buffer, so a file with a third of all rows arrives as one row per task.
    """
    bit = lambda reading, value: F.when(F.col(reading).isNotNull(), F.lit(value)).otherwise(F.lit(0))
    said = rows.where("open_order AND (date IS NOT NULL OR day_first IS NOT NULL)")
    return said.groupBy("file_no").agg(F.bit_and(bit("date", 1) + bit("day_first", 2)).alias("orders"))


def decided(rows: DataFrame, orders: DataFrame | None = None, date_order: str = "month") -> DataFrame:
    """Typed rows with their final date, and ``accepted``, ``errors`` and ``raw``.

    A file is read in one order of month and day: the one in which all its dates can be read, or, if
    both can, as ``date_order`` says. If neither can, its dates that differ by the order are
    rejected as ambiguous. Rows are atomic: one bad field rejects the row.
    """
    if date_order not in coercion.DATE_ORDERS:
        raise ValueError(f"date_order is one of {', '.join(coercion.DATE_ORDERS)}")
    month, day, both = F.col("date"), F.col("day_first"), F.lit(3)
    preferred = day if date_order.startswith("day") else month
    if date_order.endswith("only") or orders is None:
        chosen = preferred
        rows = rows.withColumn("orders", both)
    else:
        rows = rows.join(orders, "file_no", "left")
        order = F.coalesce("orders", both)
        chosen = F.when(order == 3, preferred).when(order == 1, month).when(order == 2, day)
    date = F.when(~F.col("open_order") | month.eqNullSafe(day), month).otherwise(chosen)
    text = F.coalesce("texts.date", F.lit(""))
    what = F.when(F.col("orders") == 0, F.lit("ambiguous date '")).otherwise(F.lit("invalid date '"))
    problem = F.when(F.col("_date").isNull(), F.concat(what, text, F.lit("'")))
    raw = F.concat_ws(",", *[F.coalesce(f"texts.{c}", F.lit("")) for c in RAW])
    kept = [c for c in rows.columns if c not in ("date", "day_first", "open_order", "sound", "problems", "texts", "orders")]
    return rows.withColumn("_date", date).select(
        *kept,
        F.col("_date").alias("date"),
        (F.col("sound") & F.col("_date").isNotNull()).alias("accepted"),
        F.array_compact(F.concat(F.array(problem), F.col("problems"))).alias("errors"),
        F.when(~(F.col("sound") & F.col("_date").isNotNull()), raw).alias("raw"),
    )


def validate(raw: DataFrame, seed: bool = False, date_order: str = "month") -> DataFrame:
    """Types the seven text columns and adds ``accepted``, ``errors`` and ``raw``.

    The texts are read once for the order of their dates and once for all else; a job
    stores the typed rows in between.
    """
    if seed:
        return decided(typed(raw, seed))
    date, day_first, open_order = coercion.date_readings(F.col("date"))
    read = raw.select("file_no", date.alias("date"), day_first.alias("day_first"), open_order.alias("open_order"))
    return decided(typed(raw), date_orders(read), date_order)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("accepted").drop("accepted", "errors", "raw")


def rejected(validated: DataFrame, *named: str) -> DataFrame:
    """Every bad row with its line number, texts and message, and the columns asked for."""
    return validated.filter(~F.col("accepted")).select(
        "file_no",
        *named,
        "line",
        "raw",
        F.concat(F.lit("Row "), F.col("line").cast("string"), F.lit(": "), F.array_join("errors", "; ")).alias("error"),
    )


def error_summaries(rejects: DataFrame, limit: int = 10) -> DataFrame:
    """The first errors of each file as one text, at most ``limit`` lines of it."""
    first = top_k_per_key(rejects, ["file_no"], [F.col("line")], limit, F.col("line"))
    lines = F.array_sort(F.collect_list(F.struct("line", "error")))
    texts = F.transform(lines, lambda e: e["error"])
    return first.groupBy("file_no").agg(F.array_join(texts, "\n").alias("error_message"))


def last_per_key(rows: DataFrame) -> DataFrame:
    """One row per (date, department): measures of the last row, number and file
    of the first.

    ``seq`` numbers the rows of the whole batch. Every aggregate has a fixed-width
    buffer, so this is a hash aggregation that combines before its shuffle: a key
    that fills a third of a batch arrives as one row per task.
    """
    return rows.groupBy(*KEY).agg(
        *[F.max_by(m, "seq").alias(m) for m in MEASURES],
        F.min("seq").alias("first_seq"),
        F.min_by("file_no", "seq").alias("first_file"),
    )


def first_per_key(rows: DataFrame) -> DataFrame:
    """One row per (date, department): the first row wins."""
    return rows.groupBy(*KEY).agg(
        *[F.min_by(m, "seq").alias(m) for m in MEASURES],
        F.min("seq").alias("first_seq"),
        F.min_by("file_no", "seq").alias("first_file"),
    )


def row_counts(validated: DataFrame) -> DataFrame:
    """Accepted rows and errors per file."""
    return validated.groupBy("file_no").agg(
        F.count_if(F.col("accepted")).alias("records_count"), F.count_if(~F.col("accepted")).alias("errors")
    )


def file_outcomes(files: DataFrame, counts: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Added, updated and rejected counts and the status of every file.

    ``files`` has one row per file (file_no, filename, problem), ``counts`` its
    records_count and errors, ``new_keys`` one row per newly created key with the
    ``first_file`` it came from. All are one row per file when they are joined.
    """
    added = new_keys.groupBy(F.col("first_file").alias("file_no")).agg(F.count("*").alias("records_added"))
    zero = F.lit(0).cast("bigint")
    out = files.join(counts, "file_no", "left").join(added, "file_no", "left")
    count, new = F.coalesce("records_count", zero), F.coalesce("records_added", zero)
    out = out.select(
        "file_no",
        "filename",
        "problem",
        new.alias("records_added"),
        (count - new).alias("records_updated"),
        count.alias("records_count"),
        F.coalesce("errors", zero).alias("errors"),
    )
    status = F.when(F.col("problem").isNotNull(), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    return out.withColumn("status", status)
