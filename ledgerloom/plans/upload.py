"""The upload job: files in, fact table, history, rejects and alerts out."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.functions.measures import moment
from ledgerloom.operators import ingest, merge
from ledgerloom.operators.alerts import new_alerts
from ledgerloom.schema import UPLOAD_HISTORY
from ledgerloom.session import work_folder
from ledgerloom.sources import csv_files
from ledgerloom.sources.ledger import Attempt, Ledger
from ledgerloom.sources.tables import metrics


def upload(
    ledger: Ledger,
    sources: list[str],
    batch_no: int,
    uploaded_by: int | None,
    as_of: dt.datetime,
    seed: bool = False,
    date_order: str = "month",
) -> bool:
    """Ingests all files below ``sources`` as one batch; False if that number was taken.

    An upload updates known (date, department) keys, the last row winning; a seed
    load only inserts unknown ones, the first row winning. ``date_order`` says how dates of
    numbers alone are read in files that do not show it themselves. After a failure the
    same batch may be run again, or any other.
    """
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    lines = csv_files.text_lines(ledger.spark, sources)
    listed = csv_files.listing(ledger.spark, sources)
    ingest_lines(attempt, lines, uploaded_by, as_of, seed, date_order, csv_files.BY_SOURCE, listed)
    return True


def ingest_lines(
    attempt: Attempt,
    lines: DataFrame,
    uploaded_by: int | None,
    as_of: dt.datetime,
    seed: bool,
    date_order: str,
    order: list[str],
    listed: DataFrame | None = None,
) -> bool:
    """Ingests located lines as one batch and publishes it; False, and nothing published, without files."""
    ledger, state = attempt.ledger, attempt.state
    spark = ledger.spark
    work = work_folder(spark, f"upload-{attempt.batch_no}")
    staged = csv_files.stage(spark, lines, work, seed, order, listed)
    if staged is None:
        return False
    orders = None if seed else ingest.date_orders(staged.rows.where("sound"))
    good = ingest.accepted(ingest.decided(staged.rows.where("sound"), orders, date_order))
    reduced = ledger.placed(ingest.first_per_key(good) if seed else ingest.last_per_key(good))
    seen = Observation()
    reduced.observe(seen, F.collect_set(F.struct("ym", "bucket")).alias("pieces")).write.parquet(f"{work}/keys")
    keys = spark.read.schema(reduced.schema).parquet(f"{work}/keys")

    touched = {(p["ym"], p["bucket"]) for p in metrics(seen, reduced).get("pieces", [])}
    current = ledger.read(state.only(touched)).drop("ym", "bucket")
    combine = merge.insert_if_absent if seed else merge.upsert
    combined = combine(current, keys.drop("ym", "bucket"), attempt.batch_no, moment(as_of), F.lit(uploaded_by).cast("bigint"))
    combined.write.parquet(f"{work}/merged")
    merged = spark.read.schema(combined.schema).parquet(f"{work}/merged")

    def log_files() -> None:
        bad = attempt.log("rejects", _rejected(staged, orders, date_order))
        counts = _counts(staged, orders, date_order)
        outcomes = ingest.file_outcomes(staged.files, counts, merged.where("first_file IS NOT NULL"))
        attempt.log("upload_history", history_rows(outcomes, bad, attempt.batch_no, uploaded_by, as_of, seed))

    # What does not depend on each other is written at the same time.
    with ThreadPoolExecutor(2) as pool:
        logged = pool.submit(inheritable_thread_target(spark)(log_files))
        after = state.without(touched) + attempt.write_version(merged)
        attempt.log("alerts", new_alerts(ledger.cells(after), ledger.alerts(state.version), as_of))
        logged.result()
    attempt.publish(after)
    return True


def _counts(staged: csv_files.Staged, orders: DataFrame | None, date_order: str) -> DataFrame:
    """Accepted rows and errors per file."""
    return ingest.row_counts(ingest.decided(staged.rows, orders, date_order))


def _rejected(staged: csv_files.Staged, orders: DataFrame | None, date_order: str) -> DataFrame:
    """The bad rows, named and numbered: certainly bad ones, and those that their file's date order spoils."""
    spoilt = ingest.decided(staged.rows.where("sound AND open_order"), orders, date_order).filter("NOT accepted")
    certain = ingest.decided(staged.rows.where("NOT sound"), orders, date_order)
    named = staged.files.select("file_no", "filename", "rows_before")
    bad = certain.unionByName(spoilt).join(named, "file_no")
    numbered = bad.withColumn("line", F.col("seq") - F.col("rows_before") + 2)
    return ingest.rejected(numbered, "filename")


def history_rows(
    outcomes: DataFrame, bad: DataFrame, batch_no: int, uploaded_by: int | None, as_of: dt.datetime, seed: bool
) -> DataFrame:
    """One upload_history row per file. A seed load counts the rows it added."""
    summaries = ingest.error_summaries(bad)
    count = F.col("records_added") if seed else F.col("records_count")
    return (
        outcomes.join(summaries, "file_no", "left")
        .select(
            merge.new_id(batch_no, F.col("file_no")).alias("id"),
            "filename",
            count.alias("records_count"),
            "status",
            F.coalesce("problem", "error_message").alias("error_message"),
            F.lit(uploaded_by).cast("bigint").alias("uploaded_by"),
            moment(as_of).alias("created_at"),
        )
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in UPLOAD_HISTORY])
    )
