"""Continuous ingest: new files in a folder run through the upload job.

The stream reads the lines of new files, exactly once by its checkpoint, and every micro-batch
is an ordinary upload batch on those lines, so mixed layouts, rejects, history and alerts work
as in batch and the text is read once. A micro-batch takes the next free batch number
when it runs, so edits, read marks and alert runs may commit in between; the last epoch of
every stream is part of a commit, so a micro-batch that is replayed after a failure is
skipped only if that very one was committed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.upload import ingest_lines
from ledgerloom.sources import csv_files
from ledgerloom.sources.ledger import Ledger

ORDERS = {"arrival": csv_files.BY_ARRIVAL, "name": csv_files.BY_NAME}


def arriving_lines(ledger: Ledger, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the lines of new files. Files without any text do not appear in it."""
    lines = (
        ledger.spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return lines.select("value", "_metadata")


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def start(
    ledger: Ledger,
    folder: str,
    checkpoint: str,
    uploaded_by: int | None,
    files_per_batch: int = 1000,
    interval: str | None = None,
    clock=now,
    order: str = "arrival",
    date_order: str = "month",
) -> StreamingQuery:
    """Starts the stream; every micro-batch is the ledger's next upload batch.

    Files of a micro-batch are taken in the order of their arrival, as micro-batches are,
    so the newest upload of a key wins whatever ``files_per_batch`` is. With ``order``
    "name" they are taken by path, for folders whose names say the order and that are
    complete before the stream starts.
    With ``interval`` (such as '60 seconds') it keeps polling, without it handles
    what is there and stops. Alerts are evaluated inside every batch.
    """
    by = ORDERS[order]

    def apply(batch: DataFrame, epoch: int) -> None:
        attempt = ledger.begin()
        if attempt.epochs.get(checkpoint, -1) >= epoch:
            return
        attempt.epochs[checkpoint] = epoch
        lines = csv_files.located(batch).withColumn("source_no", F.lit(0))
        ingest_lines(attempt, lines, uploaded_by, clock(), False, date_order, by)

    writer = arriving_lines(ledger, folder, files_per_batch).writeStream.foreachBatch(apply)
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
