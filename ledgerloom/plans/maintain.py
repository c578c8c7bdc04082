"""Edits and deletions on the stored tables, read marks on alerts, alert runs on demand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import merge
from ledgerloom.operators.alerts import new_alerts
from ledgerloom.operators.filters import unread
from ledgerloom.session import work_folder
from ledgerloom.sources.ledger import Attempt, Ledger, Piece


def _rewrite(attempt: Attempt, touched: set[tuple[str, int]], change) -> list[Piece]:
    """The current pieces after the touched ones were written anew."""
    ledger, state = attempt.ledger, attempt.state
    old = ledger.read(state.only(touched)).drop("ym", "bucket")
    return state.without(touched) + attempt.write_version(change(old))


def _log_alerts(attempt: Attempt, pieces: list[Piece], as_of: dt.datetime | None) -> None:
    """Evaluates the rules, unless no moment is given: then the polling stream does."""
    ledger = attempt.ledger
    if as_of is None:
        return
    attempt.log("alerts", new_alerts(ledger.cells(pieces), ledger.alerts(attempt.state.version), as_of))


def _written(attempt: Attempt, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of the work folder, so that every step sees the same rows."""
    spark = attempt.ledger.spark
    path = f"{work_folder(spark, f'{name}-{attempt.batch_no}')}/rows"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def apply_updates(ledger: Ledger, changes: DataFrame, batch_no: int, as_of: dt.datetime | None) -> bool:
    """Applies a change set (id, seq, nullable fields) and, given a moment, re-evaluates the alerts.

    Only pieces that can hold an edited record are searched; those that do, and the pieces a
    record moves to, are rewritten.
    """
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    state = attempt.state
    combined = _written(attempt, merge.combine_changes(changes, merge.EDITABLE).withColumn("seq", F.lit(0)), "updates")
    new = combined.select("id", F.col("date").alias("_date"), F.col("department").alias("_department"))
    searched = ledger.read(ledger.may_hold(combined, state)) if state.pieces else ledger.read([])
    hit = searched.select("id", "date", "department", "ym", "bucket").join(new, "id")
    target = ledger.placed(
        hit.select(
            F.coalesce("_date", "date").alias("date"), F.coalesce("_department", "department").alias("department")
        )
    )
    touched = ledger.touched(hit.select("ym", "bucket").unionByName(target.select("ym", "bucket")))
    after = _rewrite(attempt, touched, lambda rows: merge.update_records(rows, combined))
    _log_alerts(attempt, after, as_of)
    attempt.publish(after)
    return True


def apply_deletes(ledger: Ledger, ids: DataFrame, batch_no: int, as_of: dt.datetime | None) -> bool:
    """Deletes records by id; only pieces that hold one of them are rewritten."""
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    listed = _written(attempt, ids.select("id").distinct(), "deletes")
    touched = ledger.touched(ledger.read(ledger.may_hold(listed, attempt.state)).join(listed, "id", "left_semi"))
    after = _rewrite(attempt, touched, lambda rows: merge.delete_by_id(rows, listed))
    _log_alerts(attempt, after, as_of)
    attempt.publish(after)
    return True


def run_alerts(ledger: Ledger, batch_no: int, as_of: dt.datetime) -> bool:
    """Evaluates the rules on the whole table."""
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    _log_alerts(attempt, attempt.state.pieces, as_of)
    attempt.publish(attempt.state.pieces)
    return True


def mark_alerts_read(ledger: Ledger, ids: DataFrame | None, batch_no: int) -> bool:
    """Marks the listed alerts, or all unread ones, as read."""
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    marked = unread(ledger.alerts(attempt.state.version)) if ids is None else ids
    attempt.log("alert_marks", marked.select(F.col("id").cast("bigint").alias("id")))
    attempt.publish(attempt.state.pieces)
    return True


def put_users(ledger: Ledger, users: DataFrame, batch_no: int) -> bool:
    """Stores the users; stored ones with the same id take the new values, all others stay."""
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    given = _written(attempt, users, "users")
    kept = ledger.users(attempt.state).join(given.select("id"), "id", "left_anti")
    attempt.write_users(kept.unionByName(given.select(*kept.columns)))
    attempt.publish(attempt.state.pieces)
    return True


def apply_user_changes(ledger: Ledger, changes: DataFrame, batch_no: int) -> bool:
    """Applies a change set (id, seq, nullable name, role and is_active) to the stored users."""
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    attempt.write_users(merge.update_users(ledger.users(attempt.state), changes))
    attempt.publish(attempt.state.pieces)
    return True


def remove_users(ledger: Ledger, ids: DataFrame, batch_no: int) -> bool:
    """Removes users. In the same commit their records and uploads stay, without an owner.

    Only pieces that hold a record of theirs are rewritten; uploads are released by a log of the
    removed ids that the history is read with.
    """
    attempt = ledger.begin(batch_no)
    if attempt is None:
        return False
    gone = _written(attempt, ids.select(F.col("id").cast("bigint").alias("id")).distinct(), "removed")
    owned = ledger.read(attempt.state.pieces).select("ym", "bucket", F.col("created_by").alias("id"))
    touched = ledger.touched(owned.join(gone, "id", "left_semi"))
    after = _rewrite(attempt, touched, lambda rows: merge.release_owner(rows, gone, "created_by"))
    attempt.write_users(merge.delete_by_id(ledger.users(attempt.state), gone))
    attempt.log("released", gone)
    attempt.publish(after)
    return True
