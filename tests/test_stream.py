from __future__ import annotations

import datetime as dt
import os

import pytest

from ledgerloom.plans import maintain
from ledgerloom.sources.ledger import Attempt, Ledger
from ledgerloom.streaming import uploads

from test_ingest import HEADER, OTHER, put, stored

NOW = dt.datetime(2024, 6, 1)


def run(ledger, folder, tmp_path, **options):
    query = uploads.start(ledger, folder, str(tmp_path / "progress"), 3, clock=lambda: NOW, **options)
    query.awaitTermination()


def test_files_arriving_over_time(spark, tmp_path):
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), buckets=1)
    folder = put(tmp_path / "in", "1.csv", HEADER, "2024-01-01,100,0,5,A,0,1")
    run(ledger, folder, tmp_path)
    assert stored(ledger) == {("2024-01-01", "A"): (100, 1, 3)}
    run(ledger, folder, tmp_path)
    assert ledger.last_batch() == 1

    put(tmp_path / "in", "2.csv", OTHER, "2,0,A,50,0,200,2024-01-01,late", "3,0,A,1,0,20,2024-02-01,")
    put(tmp_path / "in", "3.csv", "Date,Revenue", "2024-01-01,1")
    run(ledger, folder, tmp_path)
    assert stored(ledger) == {("2024-01-01", "A"): (200, 2, 3), ("2024-02-01", "A"): (20, 3, 3)}
    statuses = {r.filename: r.status for r in ledger.upload_history().collect()}
    assert statuses == {"1.csv": "success", "2.csv": "success", "3.csv": "failed"}
    assert sorted(r.type for r in ledger.alerts().collect()) == ["low_margin", "revenue_drop"]


def test_one_file_per_batch_keeps_arrival_order(spark, tmp_path):
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), buckets=1)
    for number in (1, 2, 3):
        folder = put(tmp_path / "in", f"{9 - number}.csv", HEADER, f"2024-01-01,{number},0,{number},A,0,{number}")
        os.utime(tmp_path / "in" / f"{9 - number}.csv", (1_700_000_000 + number, 1_700_000_000 + number))
    run(ledger, folder, tmp_path, files_per_batch=1)
    assert ledger.last_batch() == 3
    assert stored(ledger) == {("2024-01-01", "A"): (3, 3, 3)}


def test_the_newest_upload_wins_at_any_batch_size(spark, tmp_path):
    for size in (1, 1000):
        ledger = Ledger.create(spark, str(tmp_path / f"ledger-{size}"), buckets=1)
        folder = put(tmp_path / f"in-{size}", "z.csv", HEADER, "2024-01-01,1,0,1,A,0,1")
        put(tmp_path / f"in-{size}", "a.csv", HEADER, "2024-01-01,2,0,2,A,0,2")
        os.utime(tmp_path / f"in-{size}" / "z.csv", (1_700_000_000, 1_700_000_000))
        os.utime(tmp_path / f"in-{size}" / "a.csv", (1_700_000_001, 1_700_000_001))
        query = uploads.start(ledger, folder, str(tmp_path / f"progress-{size}"), 3, size, clock=lambda: NOW)
        query.awaitTermination()
        assert stored(ledger) == {("2024-01-01", "A"): (2, 2, 3)}


def test_other_jobs_may_commit_between_runs(spark, tmp_path):
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), buckets=1)
    folder = put(tmp_path / "in", "1.csv", HEADER, "2024-01-01,100,0,5,A,0,1")
    run(ledger, folder, tmp_path)
    first = ledger.read().select("id")
    assert maintain.run_alerts(ledger, ledger.last_batch() + 1, NOW)
    changes = first.selectExpr(
        "id", "0 AS seq", "cast(null as date) date", "cast(7 as decimal(15,2)) revenue", "cast(null as decimal(15,2)) cost",
        "cast(null as decimal(15,2)) expenses", "cast(null as decimal(15,2)) profit", "cast(null as string) department",
        "cast(null as bigint) sales_volume",
    )
    assert maintain.apply_updates(ledger, changes, ledger.last_batch() + 1, NOW)
    assert maintain.mark_alerts_read(ledger, None, ledger.last_batch() + 1)
    put(tmp_path / "in", "2.csv", HEADER, "2024-01-02,50,0,5,B,0,1")
    run(ledger, folder, tmp_path)
    assert {key: row[0] for key, row in stored(ledger).items()} == {("2024-01-01", "A"): 7, ("2024-01-02", "B"): 50}
    assert sorted(r.filename for r in ledger.upload_history().collect()) == ["1.csv", "2.csv"]
    # A replayed micro-batch is known by its stream and number, not by the batch's.
    assert ledger.has_epoch(str(tmp_path / "progress"), 1)
    assert not ledger.has_epoch(str(tmp_path / "progress"), 2)
    assert not ledger.has_epoch("another", 1)


def test_ids_of_another_batch_are_never_given(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.merge import new_id

    fits = spark.range(1).select(new_id(1, F.lit(2**40 - 1)).alias("a"), new_id(2, F.lit(0)).alias("b")).first()
    assert fits.a + 1 == fits.b
    with pytest.raises(Exception, match="split it"):
        spark.range(1).select(new_id(1, F.lit(2**40))).collect()


def test_a_batch_that_dies_is_taken_up_again(spark, tmp_path, monkeypatch):
    """The stream dies just before its commit, another job commits, the stream starts again."""
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), buckets=1)
    folder = put(tmp_path / "in", "1.csv", HEADER, "2024-01-01,100,0,5,A,0,1", "2024-01-02,bad,0,5,A,0,1")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Attempt, "publish", lost)
        with pytest.raises(Exception, match="lost"):
            run(ledger, folder, tmp_path)
    assert maintain.run_alerts(ledger, ledger.last_batch() + 1, NOW)
    assert ledger.upload_history().count() == ledger.rejects().count() == ledger.alerts().count() == 0
    for _ in range(2):
        run(ledger, folder, tmp_path)
        assert stored(ledger) == {("2024-01-01", "A"): (100, 1, 3)}
        assert ledger.upload_history().count() == ledger.rejects().count() == ledger.alerts().count() == 1


def test_files_of_other_kinds_are_logged(spark, tmp_path):
    ledger = Ledger.create(spark, str(tmp_path / "ledger"), buckets=1)
    folder = put(tmp_path / "in", "1.csv", HEADER, "2024-01-01,100,0,50,A,0,1")
    put(tmp_path / "in", "book.xlsx", "PK", "more", "lines")
    run(ledger, folder, tmp_path)
    statuses = {r.filename: r.status for r in ledger.upload_history().collect()}
    assert statuses == {"1.csv": "success", "book.xlsx": "failed"}
    assert uploads.arriving_lines(ledger, folder).columns == ["value", "_metadata"]
