"""Alerts as a stream of their own: whatever commits to the ledger is evaluated at the next poll.

The stream follows the ledger's commits, not files, so edits, deletions and uploads all count.
Open alerts are the state, kept by type and department in the ledger itself: an alert that is
open is not raised again, and one that was marked as read is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.alerts import new_alerts
from ledgerloom.session import work_folder
from ledgerloom.sources.ledger import COMMIT, Ledger
from ledgerloom.streaming.uploads import now


def commits(ledger: Ledger) -> DataFrame:
    """Stream of the ledger's commits."""
    return ledger.spark.readStream.schema(COMMIT).parquet(f"{ledger.root}/commits")


def start(ledger: Ledger, checkpoint: str, interval: str | None = None, clock=now) -> StreamingQuery:
    """Starts the stream; each poll that finds commits evaluates the rules on the table as it is then.

    New alerts are a commit of their own; without any nothing is committed, so the stream's own
    commits do not keep it going. With ``interval`` (such as '60 seconds') it keeps polling,
    without it handles what is there and stops. A poll that died is repeated; what it raised
    is open then and not raised again.
    """
    spark = ledger.spark

    def apply(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        attempt = ledger.begin()
        state = attempt.state
        raised = new_alerts(ledger.cells(state.pieces), ledger.alerts(state.version), clock())
        path = work_folder(spark, f"raised-{state.version}")
        raised.write.parquet(path)
        found = spark.read.schema(raised.schema).parquet(path)
        if not found.isEmpty():
            attempt.log("alerts", found)
            attempt.publish(state.pieces)

    writer = commits(ledger).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
