from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ledgerloom.functions import coercion
from ledgerloom.functions.headers import fields, with_layout
from ledgerloom.operators import alerts, departments, ingest, kpis, merge, reports, trends
from ledgerloom.operators.filters import Scope
from ledgerloom.plans import maintain
from ledgerloom.plans.report import write_printable, write_report
from ledgerloom.plans.upload import upload
from ledgerloom.sources import csv_files
from ledgerloom.sources.ledger import Attempt, Ledger

NOW = dt.datetime(2024, 6, 1)
HEADER = "Date,Revenue,Cost,Profit,Department,Expenses,Sales Volume"
OTHER = "Sales_Volume, EXPENSES ,department,profit,cost,revenue,date,Note"


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger.create(spark, str(tmp_path / "ledger"), buckets=2)


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def stored(ledger):
    rows = ledger.read().collect()
    return {(r.date.isoformat(), r.department): (float(r.revenue), r.sales_volume, r.created_by) for r in rows}


def history(ledger):
    return {r.filename: (r.status, r.records_count, r.error_message) for r in ledger.upload_history().collect()}


# -- headers ------------------------------------------------------------------


def laid_out(spark, *lines, required=True):
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, header string")
    return [(r.problem, r.width, r.at.asDict()) for r in with_layout(frame, required).sort("i").collect()]


def test_header_spellings(spark):
    for sales in ["Sales Volume", "sales_volume", "SalesVolume", " SALES ", "sales volume", '"Sales"', "Sales\u00a0"]:
        problem, width, at = laid_out(spark, f"\ufeff date ,REVENUE,Cost,profit,Department,expenses,{sales}")[0]
        assert problem is None and width == 7 and at["sales_volume"] == 6 and at["date"] == 0


def test_header_problems(spark):
    found = laid_out(spark, "Date,Revenue,Cost,Profit", HEADER + ",Sales", "", None, HEADER + ",Revenue", '"a, ""b""",' + HEADER)
    assert [problem for problem, _, _ in found] == [
        "Missing required columns: Department, Expenses, Sales Volume",
        "Ambiguous columns for Sales Volume",
        "No columns to parse from file",
        "No columns to parse from file",
        None,
        None,
    ]
    assert found[4][2]["revenue"] == 1 and found[5][1:] == (8, {**found[5][2], "date": 1, "sales_volume": 7})
    seed = laid_out(spark, "date,revenue", required=False)[0]
    assert seed[0] is None and seed[2]["cost"] is None
    line = spark.createDataFrame([('a,"b, ""c""",,d',)], "line string")
    assert line.select(fields(F.col("line"))).first()[0] == ["a", 'b, "c"', "", "d"]


# -- rows ---------------------------------------------------------------------


def raw(spark, **fields):
    row = {
        "file_no": 0, "filename": "f.csv", "seq": 0, "line": 2, "date": "2024-01-05", "revenue": "100", "cost": "1",
        "expenses": "2", "profit": "3", "department": "X", "sales_volume": "4", **fields,
    }
    schema = "file_no long, filename string, seq long, line long, " + ", ".join(f"{c} string" for c in ingest.RAW)
    return spark.createDataFrame([tuple(row[c] for c in ["file_no", "filename", "seq", "line", *ingest.RAW])], schema)


@pytest.mark.parametrize(
    "field, text, expected",
    [
        ("date", "2024-1-5", "2024-01-05"),
        ("date", " 2024/01/05 ", "2024-01-05"),
        ("date", "01/05/2024", "2024-01-05"),
        ("date", "25/01/2024", "2024-01-25"),
        ("date", "Jan 5, 2024", "2024-01-05"),
        ("date", "5 January 2024", "2024-01-05"),
        ("date", "2024-01-05 10:30:00", "2024-01-05"),
        ("date", "2024-01-05T10:30:00", "2024-01-05"),
        ("date", "2024-13-01", None),
        ("date", "2024-02-30", None),
        ("date", "2024-01-05 nonsense", None),
        ("date", "", None),
        ("date", None, None),
        ("revenue", " 12.5 ", "12.50"),
        ("revenue", "1e3", "1000.00"),
        ("revenue", "-7", "-7.00"),
        ("revenue", "x", None),
        ("revenue", "1,000", None),
        ("revenue", "inf", None),
        ("revenue", "nan", None),
        ("expenses", "", None),
        ("sales_volume", "12.7", "12"),
        ("sales_volume", "-12.7", "-12"),
        ("sales_volume", "12.99999", "12"),
        ("sales_volume", "abc", None),
        ("sales_volume", "1e30", None),
        ("sales_volume", None, None),
        ("department", "  padded ", "padded"),
        ("department", "   ", None),
        ("department", "N/A", None),
    ],
)
def test_coercion(spark, field, text, expected):
    row = ingest.validate(raw(spark, **{field: text})).first()
    if expected is None:
        assert row.errors == [f"invalid {field.replace('_', ' ')} '{text or ''}'"]
    else:
        assert row.errors == [] and row.raw is None and str(row[field]) == expected


def test_seed_rules_are_strict(spark):
    assert ingest.validate(raw(spark, date="2024/01/05"), seed=True).first().errors
    assert ingest.validate(raw(spark, sales_volume="12.7"), seed=True).first().errors
    assert ingest.validate(raw(spark, sales_volume=""), seed=True).first().sales_volume == 0


def test_hot_key_reduction(spark):
    """A key with most of the rows: last and first row agree with a plain loop, and
    the plan combines before it shuffles, with hash aggregation only."""
    rng = random.Random(5)
    rows = [(i, i % 3, dt.date(2024, 1, 1 + (0 if rng.random() < 0.8 else rng.randrange(20))), "X", rng.randrange(10**6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, file_no long, date date, department string, revenue long").repartition(8)
    for m in ("cost", "expenses", "profit", "sales_volume"):
        df = df.withColumn(m, df.revenue)
    for reducer, pick in ((ingest.last_per_key, max), (ingest.first_per_key, min)):
        reduced = reducer(df)
        expected = {}
        for row in rows:
            expected.setdefault(row[2], []).append(row)
        found = {r.date: (r.revenue, r.first_seq, r.first_file) for r in reduced.collect()}
        assert found == {d: (pick(g)[4], min(g)[0], min(g)[1]) for d, g in expected.items()}
        plan = reduced._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and "SortAggregate" not in plan


# -- files --------------------------------------------------------------------


def test_mixed_layouts_are_matched_by_name(spark, ledger, tmp_path):
    put(tmp_path / "in" / "sub", "a.csv", HEADER, "2024-01-01,100,50,40,Sales,10,7")
    put(tmp_path / "in", "b.CSV", OTHER, '8,1,"Ops, North",2,3,200,2024-01-02,"said ""hi"""')
    assert upload(ledger, [str(tmp_path / "in")], 1, 5, NOW)
    assert stored(ledger) == {("2024-01-01", "Sales"): (100, 7, 5), ("2024-01-02", "Ops, North"): (200, 8, 5)}
    row = ledger.read().filter("department = 'Ops, North'").first()
    assert (float(row.cost), float(row.profit), float(row.expenses)) == (3, 2, 1)


def test_file_level_outcomes(spark, ledger, tmp_path):
    folder = tmp_path / "in"
    put(folder, "good.csv", HEADER, "2024-01-01,1,1,1,A,1,1")
    put(folder, "short.csv", "Date,Revenue,Cost,Profit,Department,Sales", "2024-01-01,1,1,1,B,1")
    put(folder, "both.csv", HEADER + ",Sales", "2024-01-01,1,1,1,C,1,1,1")
    put(folder, "notes.txt", HEADER, "2024-01-01,1,1,1,D,1,1")
    put(folder, "book.xlsx", "PK")
    (folder / "empty.csv").write_text("\n\n")
    put(folder, "header only.csv", HEADER)
    put(folder, "odd [1]*.csv", HEADER, "2024-01-01,9,1,1,E,1,1")
    upload(ledger, [str(folder)], 1, 5, NOW)
    assert {k[1] for k in stored(ledger)} == {"A", "E"}
    assert history(ledger) == {
        "good.csv": ("success", 1, None),
        "short.csv": ("failed", 0, "Missing required columns: Expenses"),
        "both.csv": ("failed", 0, "Ambiguous columns for Sales Volume"),
        "notes.txt": ("failed", 0, "Invalid file format. Please upload CSV or Excel file."),
        "book.xlsx": ("failed", 0, "Excel workbooks cannot be read; upload CSV"),
        "empty.csv": ("failed", 0, "No columns to parse from file"),
        "header only.csv": ("success", 0, None),
        "odd [1]*.csv": ("success", 1, None),
    }
    ids = [r.id for r in ledger.upload_history().collect()]
    assert len(set(ids)) == 8


def test_bad_rows_are_reported_and_others_kept(spark, ledger, tmp_path):
    lines = [f"2024-01-{d:02d},{'x' if d % 2 else d},1,1,A,1,1" for d in range(1, 25)]
    lines.insert(3, "")
    lines += ["2024-02-01,1,1,1,A,1,1,surplus", "2024-02-02,1,1,1,A"]
    upload(ledger, [put(tmp_path / "in", "f.csv", HEADER, *lines)], 1, 5, NOW)
    assert len(stored(ledger)) == 12
    rejects = {r.line: r.error for r in ledger.rejects().collect()}
    assert rejects == {
        **{d + 1: f"Row {d + 1}: invalid revenue 'x'" for d in range(1, 25, 2)},
        26: "Row 26: more fields than columns",
        27: "Row 27: invalid expenses ''; invalid sales volume ''",
    }
    status, count, text = history(ledger)["f.csv"]
    assert (status, count) == ("partial", 12)
    assert text.split("\n") == [rejects[line] for line in sorted(rejects)[:10]]


def test_last_row_wins_across_and_inside_files(spark, ledger, tmp_path):
    folder = tmp_path / "in"
    put(folder, "1.csv", HEADER, "2024-01-01,1,0,0,A,0,1", "2024-01-01,2,0,0, A ,0,2")
    put(folder, "2.csv", HEADER, "2024-01-01,3,0,0,A,0,3", "2024-01-02,4,0,0,A,0,4")
    upload(ledger, [str(folder)], 1, 5, NOW)
    assert stored(ledger) == {("2024-01-01", "A"): (3, 3, 5), ("2024-01-02", "A"): (4, 4, 5)}
    assert {k: v[:2] for k, v in history(ledger).items()} == {"1.csv": ("success", 2), "2.csv": ("success", 2)}


def test_update_keeps_owner_id_and_creation_time(spark, ledger, tmp_path):
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,1,0,0,A,0,1", "2024-01-05,5,0,0,B,0,5")], 1, 1, NOW)
    first = {r.department: r for r in ledger.read().collect()}
    later = NOW + dt.timedelta(days=1)
    upload(ledger, [put(tmp_path / "b", "b.csv", HEADER, "2024-01-01,2,0,0,A,0,2", "2024-01-02,3,0,0,A,0,3")], 2, 2, later)
    rows = {(r.date.day, r.department): r for r in ledger.read().collect()}
    kept = rows[(1, "A")]
    assert (kept.id, kept.created_by, kept.created_at) == (first["A"].id, 1, NOW) and kept.revenue == 2
    assert rows[(2, "A")].created_by == 2 and rows[(2, "A")].created_at == later
    assert len({r.id for r in rows.values()}) == 3


def test_null_owner_stays_null(spark, ledger, tmp_path):
    source = [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,1,0,0,A,0,1")]
    upload(ledger, source, 1, None, NOW, seed=True)
    upload(ledger, source, 2, 9, NOW)
    assert stored(ledger) == {("2024-01-01", "A"): (1, 1, None)}


def test_seed_load_first_wins_with_defaults(spark, ledger, tmp_path):
    a = put(tmp_path / "a", "z.csv", "date,revenue,cost", "2024-01-01,1,1", "2024/01/02,2,2", "2024-01-01,3,3")
    b = put(tmp_path / "b", "a.csv", HEADER, "2024-01-01,9,0,0,Unknown,0,9", "2024-01-01,5,0,0,A,0,")
    upload(ledger, [a, b], 1, None, NOW, seed=True)
    assert stored(ledger) == {("2024-01-01", "Unknown"): (1, 0, None), ("2024-01-01", "A"): (5, 0, None)}
    assert {k: v[:2] for k, v in history(ledger).items()} == {"z.csv": ("partial", 1), "a.csv": ("success", 1)}


@pytest.mark.parametrize("broadcast", [0, csv_files.BROADCAST_BLOCKS])
def test_row_numbers_survive_many_splits(spark, tmp_path, monkeypatch, broadcast):
    """Files cut into many blocks and packed into tasks in any order."""
    folder = tmp_path / "in"
    counts = {"a.csv": 4000, "b.csv": 1, "c.csv": 2500}
    for name, n in counts.items():
        put(folder, name, HEADER, *[f"2024-01-01,{i},0,0,{name},0,{i}" + "\n" * (i % 50 == 7) for i in range(n)])
    monkeypatch.setattr(csv_files, "BROADCAST_BLOCKS", broadcast)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = csv_files.text_lines(spark, [str(folder)])
        staged = csv_files.stage(spark, lines, str(tmp_path / "work"), False, csv_files.BY_SOURCE)
        assert spark.read.parquet(str(tmp_path / "work" / "blocks")).count() > 20
        files = staged.files.select("file_no", "rows_before", "filename", "n_rows")
        rows = staged.rows.join(files, "file_no").withColumn("line", F.col("seq") - F.col("rows_before") + 2)
        found = rows.select("seq", "line", "department", "sales_volume", "file_no").toPandas().sort_values("seq")
        assert list(found.seq) == list(range(6501))
        assert list(found.department) == [name for name, n in counts.items() for _ in range(n)]
        assert list(found.line) == [i + 2 for n in counts.values() for i in range(n)]
        assert list(found.sales_volume) == [i for n in counts.values() for i in range(n)]
        listed = {r.filename: (r.file_no, r.n_rows) for r in files.collect()}
        assert listed == {"a.csv": (0, 4000), "b.csv": (1, 1), "c.csv": (2, 2500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_is_read_once(spark, ledger, tmp_path, monkeypatch):
    """Only the first table written from an upload scans its text."""
    scans = []
    write = DataFrameWriter.parquet

    def counted(self, path, *args, **kwargs):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        scans.append((path.rsplit("/", 1)[-1], plan.count("FileScan text")))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    source = put(tmp_path / "in", "a.csv", HEADER, "2024-01-01,1,0,0,A,0,1", "x,1,0,0,A,0,1")
    upload(ledger, [source], 1, 1, NOW)
    assert dict(scans)["lines"] == 1 and sum(n for _, n in scans) == 1


def test_many_files_are_numbered_in_order(spark, tmp_path):
    """A listing of 100,000 files of different sizes, without any of them on the driver."""
    n = 100_000
    listed = spark.range(n).select(
        F.format_string("f%06d.csv", F.lit(n - 1) - F.col("id")).alias("uri"), (F.col("id") % 7).alias("n_rows")
    )
    ordered = listed.repartitionByRange(16, "uri").sortWithinPartitions("uri").withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    )
    ordered.write.parquet(str(tmp_path / "files"))
    numbered = csv_files._numbered(spark.read.parquet(str(tmp_path / "files")))
    found = numbered.toPandas().sort_values("uri")
    assert list(found.file_no) == list(range(n))
    assert list(found.rows_before) == [0, *found.n_rows.cumsum()[:-1]]


def test_a_file_has_one_date_order(spark, ledger, tmp_path):
    folder = tmp_path / "in"
    row = lambda date, department: f"{date},1,0,0,{department},0,1"
    put(folder, "day.csv", HEADER, row("03/04/2024", "A"), row("13/04/2024", "A"), row("2024-05-01", "A"))
    put(folder, "month.csv", HEADER, row("03/04/2024", "B"), row("04/13/2024", "B"), row("99/99/2024", "B"))
    put(folder, "open.csv", HEADER, row("03/04/2024", "C"), row("05-06-2024", "C"))
    put(folder, "both.csv", HEADER, row("13/04/2024", "D"), row("04/13/2024", "D"), row("05/05/2024", "D"), row('"Mar 4, 2024"', "D"))
    upload(ledger, [str(folder)], 1, 5, NOW)
    assert sorted(stored(ledger)) == [
        ("2024-03-04", "B"), ("2024-03-04", "C"), ("2024-03-04", "D"), ("2024-04-03", "A"), ("2024-04-13", "A"),
        ("2024-04-13", "B"), ("2024-05-01", "A"), ("2024-05-05", "D"), ("2024-05-06", "C"),
    ]
    assert sorted((r.filename, r.error) for r in ledger.rejects().collect()) == [
        ("both.csv", "Row 2: ambiguous date '13/04/2024'"),
        ("both.csv", "Row 3: ambiguous date '04/13/2024'"),
        ("month.csv", "Row 4: invalid date '99/99/2024'"),
    ]
    for order, kept in [("day", ["2024-04-03", "2024-06-05"]), ("day only", ["2024-04-03", "2024-06-05"]), ("month only", ["2024-03-04", "2024-05-06"])]:
        other = Ledger.create(spark, str(tmp_path / order), buckets=1)
        upload(other, [f"{folder}/open.csv"], 1, 5, NOW, date_order=order)
        assert sorted(date for date, _ in stored(other)) == kept


def test_blanks_are_stripped_in_linear_time(spark):
    import time

    wide = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 100_000), F.lit("b")).alias("x"))
    wide.select(coercion.department(F.col("x"))).collect()
    started = time.perf_counter()
    assert len(wide.select(coercion.department(F.col("x")), coercion.money(F.col("x"))).first()[0]) == 100_002
    assert time.perf_counter() - started < 1
    odd = spark.createDataFrame([("\u3000\u00a0\x1f 7.5\x85\t",)], "x string").select(coercion.money(F.col("x")))
    assert str(odd.first()[0]) == "7.50"


def test_same_batch_again_is_skipped_and_a_new_one_changes_nothing(spark, ledger, tmp_path):
    source = [put(tmp_path / "a", "a.csv", HEADER, *[f"2024-0{m}-01,{m},0,{m},A,0,{m}" for m in range(1, 7)])]
    assert upload(ledger, source, 1, 1, NOW)
    before = sorted(map(tuple, ledger.read().collect()))
    assert not upload(ledger, source, 1, 1, NOW)
    assert upload(ledger, source, 2, 2, NOW)
    assert sorted(map(tuple, ledger.read().collect())) == before


def test_failed_attempt_is_invisible_and_repeatable(spark, ledger, tmp_path, monkeypatch):
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,1,0,1,A,0,1")], 1, 1, NOW)
    source = [put(tmp_path / "b", "b.csv", HEADER, "2024-01-01,2,0,1,A,0,2", "2024-02-01,bad,0,0,A,0,1", "2024-03-01,3,0,1,A,0,3")]

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Attempt, "publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            upload(ledger, source, 2, 2, NOW)
    assert stored(ledger) == {("2024-01-01", "A"): (1, 1, 1)}
    assert set(history(ledger)) == {"a.csv"} and ledger.rejects().count() == 0 and ledger.last_batch() == 1
    assert upload(ledger, source, 2, 2, NOW)
    assert stored(ledger) == {("2024-01-01", "A"): (2, 2, 1), ("2024-03-01", "A"): (3, 3, 2)}
    assert ledger.rejects().count() == 1 and len(ledger.upload_history().collect()) == 2


def test_what_a_dead_attempt_left_stays_unseen(spark, ledger, tmp_path, monkeypatch):
    """Also when another job commits under the number that it had."""
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,1,0,1,A,0,1")], 1, 1, NOW)
    source = [put(tmp_path / "b", "b.csv", HEADER, "2024-01-01,2,5,-9,A,8,2", "2024-02-01,bad,0,0,A,0,1")]

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Attempt, "publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            upload(ledger, source, 2, 2, NOW)
    assert maintain.run_alerts(ledger, 2, NOW)
    assert set(history(ledger)) == {"a.csv"} and ledger.rejects().count() == 0 and ledger.alerts().count() == 0
    assert not upload(ledger, source, 2, 2, NOW) and upload(ledger, source, 3, 2, NOW)
    assert set(history(ledger)) == {"a.csv", "b.csv"} and ledger.rejects().count() == 1
    assert Ledger.open(spark, ledger.root).last_batch() == 3


def test_a_commit_that_was_cut_short_does_not_count(spark, ledger, tmp_path):
    source = [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,1,0,1,A,0,1")]
    upload(ledger, source, 1, 1, NOW)
    (tmp_path / "ledger" / "commits" / "version=2" / "_temporary").mkdir(parents=True)
    assert ledger.last_batch() == 1 and Ledger.open(spark, ledger.root).state().version == 1
    assert upload(ledger, source, 2, 1, NOW) and Ledger.open(spark, ledger.root).state().version == 2


# -- stored table -------------------------------------------------------------


def fill(ledger, tmp_path):
    rows = [f"2024-0{m}-01,{100 * m},10,{90 * m},{d},5,{m}" for m in range(1, 5) for d in "ABC"]
    upload(ledger, [put(tmp_path / "fill", "f.csv", HEADER, *rows)], 1, 1, NOW)
    return {(r.date.month, r.department): r.id for r in ledger.read().collect()}


def test_an_edit_opens_only_pieces_that_can_hold_its_id(spark, ledger, tmp_path):
    rows = [f"20{y}-{m:02d}-{d:02d},{m},0,{m},{name},0,{d}" for y in (22, 23, 24) for m in range(1, 13) for d in (1, 9) for name in "ABCDE"]
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, *rows)], 1, 1, NOW)
    upload(ledger, [put(tmp_path / "b", "b.csv", HEADER, "2024-02-03,7,0,7,A,0,7")], 2, 1, NOW)
    state = ledger.state()
    assert len(state.pieces) == 72
    for row in ledger.read().where("sales_volume = 7 OR (department = 'C' AND day(date) = 9)").collect():
        wanted = spark.createDataFrame([(row.id,)], "id long")
        held = ledger.may_hold(wanted)
        assert (row.ym, row.bucket) in {(p.ym, p.bucket) for p in held} and len(held) <= 2
        assert len(ledger.read(held).inputFiles()) == len(held)
    assert ledger.may_hold(spark.createDataFrame([(-5,), (2**50,)], "id long")) == []
    assert ledger.may_hold(ledger.read().select("id").unionByName(spark.range(2000))) == state.pieces
    one = ledger.read().where("sales_volume = 7").select("id")
    assert maintain.apply_deletes(ledger, one, 3, NOW)
    after = ledger.state().pieces
    assert sum(p.held_by == 3 for p in after) == 1 and len(after) == 72


def test_only_touched_pieces_are_rewritten(spark, ledger, tmp_path):
    fill(ledger, tmp_path)
    before = {(p.ym, p.bucket): p.held_by for p in ledger.state().pieces}
    upload(ledger, [put(tmp_path / "u", "u.csv", HEADER, "2024-02-01,7,0,7,A,0,7")], 2, 1, NOW)
    after = {(p.ym, p.bucket): p.held_by for p in ledger.state().pieces}
    assert set(after) == set(before) and [k[0] for k in after if after[k] == 2] == ["2024-02"]
    assert len(stored(ledger)) == 12


def test_scope_prunes_pieces(spark, ledger, tmp_path):
    fill(ledger, tmp_path)
    scoped = ledger.scoped(Scope("2024-02-01", "2024-03-15", "B"))
    assert sorted(r.date.month for r in scoped.collect()) == [2, 3]
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "ym" in filters and "bucket" in filters


def test_cells_give_the_same_metrics_as_rows(spark, ledger, tmp_path):
    lines = [
        f"2024-0{m}-{d:02d},{(m * d * 37) % 900 - 20},{d},{(m * d * 13) % 500 - 90},{name},{d},{m}"
        for m in range(1, 6) for d in range(1, 20, 3) for name in ("A", "B", "C")
    ]
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, *lines, "2024-02-01,0,1,1,Z,1,1")], 1, 1, NOW)
    upload(ledger, [put(tmp_path / "b", "b.csv", HEADER, "2024-03-01,5000,1,1,A,1,1", "2024-07-01,9,1,1,D,1,1")], 2, 1, NOW)
    rows, cells = ledger.read(), ledger.cells()
    assert cells.count() < rows.count()
    metrics = [
        kpis.kpi_summary, trends.revenue_trend, trends.monthly_growth, trends.monthly_growth_by_department,
        departments.distribution, departments.profitability, departments.top_and_worst, departments.revenue_shares,
        departments.report_summary, alerts.evaluate, lambda df: kpis.month_kpis(df, "2024-03"),
    ]
    for metric in metrics:
        assert sorted(map(tuple, metric(rows).collect()), key=str) == sorted(map(tuple, metric(cells).collect()), key=str)


def test_deletes_can_empty_a_piece(spark, ledger, tmp_path):
    ids = fill(ledger, tmp_path)
    gone = [i for (month, _), i in ids.items() if month == 2]
    assert maintain.apply_deletes(ledger, spark.createDataFrame([(i,) for i in gone], "id long"), 2, NOW)
    assert sorted({k[0] for k in stored(ledger)}) == ["2024-01-01", "2024-03-01", "2024-04-01"]
    assert "2024-02" not in {p.ym for p in ledger.state().pieces}
    everything = ledger.read().select("id")
    assert maintain.apply_deletes(ledger, everything, 3, NOW)
    assert stored(ledger) == {} and ledger.read().count() == 0


CHANGES = "id long, seq long, date date, revenue decimal(15,2), cost decimal(15,2), expenses decimal(15,2), profit decimal(15,2), department string, sales_volume long"


def change(row_id, seq, date=None, revenue=None, department=None):
    from decimal import Decimal

    return (row_id, seq, date, None if revenue is None else Decimal(revenue), None, None, None, department, None)


def test_updates(spark, ledger, tmp_path):
    ids = fill(ledger, tmp_path)
    changes = [
        change(ids[(1, "A")], 1, revenue=1),
        change(ids[(1, "A")], 2, revenue=2),
        change(ids[(1, "A")], 3, department="Z"),
        change(ids[(2, "A")], 4, date=dt.date(2024, 3, 1), revenue=77),  # taken by a stored record
        change(ids[(1, "B")], 5, date=dt.date(2024, 9, 1)),
        change(ids[(2, "B")], 6, date=dt.date(2024, 9, 1)),  # taken by the change before
        change(999, 7, revenue=5),  # no such record
    ]
    frame = spark.createDataFrame(changes, CHANGES)
    refused = merge.colliding_changes(ledger.read(), merge.combine_changes(frame, merge.EDITABLE))
    lower, higher = sorted([ids[(1, "B")], ids[(2, "B")]])
    assert {r.id for r in refused.collect()} == {ids[(2, "A")], higher}
    assert maintain.apply_updates(ledger, frame, 2, NOW)
    by_id = {r.id: r for r in ledger.read().collect()}
    assert len(by_id) == 12
    moved = by_id[ids[(1, "A")]]
    assert (moved.department, float(moved.revenue)) == ("Z", 2)
    assert (by_id[ids[(2, "A")]].date.month, float(by_id[ids[(2, "A")]].revenue)) == (2, 200)
    assert by_id[lower].date.month == 9 and by_id[higher].date.month in (1, 2)


def test_alerts_on_demand_and_marks(spark, ledger, tmp_path):
    upload(ledger, [put(tmp_path / "a", "a.csv", HEADER, "2024-01-01,100,0,5,A,0,1", "2024-02-01,50,0,2,A,0,1")], 1, 1, NOW)
    assert {r.type for r in ledger.alerts().collect()} == {"low_margin", "revenue_drop"}
    maintain.run_alerts(ledger, 2, NOW)
    assert ledger.alerts().count() == 2
    low = ledger.alerts().filter("type = 'low_margin'").select("id")
    maintain.mark_alerts_read(ledger, low, 3)
    assert [r.type for r in ledger.alerts().filter("not is_read").collect()] == ["revenue_drop"]
    maintain.run_alerts(ledger, 4, NOW + dt.timedelta(hours=1))
    assert ledger.alerts().count() == 3
    maintain.mark_alerts_read(ledger, None, 5)
    assert ledger.alerts().filter("not is_read").count() == 0


def test_owner_release_and_user_changes(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, created_by long")
    removed = spark.createDataFrame([(10,), (10,)], "id long")
    assert sorted(map(tuple, merge.release_owner(children, removed, "created_by").collect())) == [(1, None), (2, 11), (3, None)]


def test_report_files(spark, tmp_path, facts):
    df = facts(*[(f"2024-01-{i:02d}", d, 100 * i, 10, 5, i, 1000 * i) for i in range(1, 31) for d in ("A", "B" * 20)])
    paths = write_report(df, str(tmp_path / "report"))
    kpis = spark.read.option("header", "true").csv(paths["kpi_summary"]).collect()
    assert [r.metric for r in kpis] == list(reports.KPI_SHEET)
    assert spark.read.option("header", "true").csv(paths["business_data"]).count() == 60
    assert spark.read.option("header", "true").csv(paths["department_summary"]).count() == 2
    printed = write_printable(df, str(tmp_path / "printed"), Scope("2024-01-02"))
    rows = spark.read.option("header", "true").csv(printed["business_data_summary"]).collect()
    assert len(rows) == 50 and rows[0].date == "2024-01-30" and rows[0].revenue == "$3,000.00" and rows[0].sales == "30,000"
    assert {len(r.department) for r in rows} == {1, 15}


@pytest.mark.parametrize("write", [write_report, write_printable])
def test_reports_compute_their_records_once(spark, tmp_path, facts, write):
    df = facts(*[(f"2024-01-{i:02d}", d, 100 * i, 10, 5, i) for i in range(1, 31) for d in "AB"])
    computed = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    paths = write(df.mapInArrow(note, df.schema), str(tmp_path / "report"))
    assert computed.value == 60
    assert all(spark.read.option("header", "true").csv(path).count() for path in paths.values())


def test_stored_users_and_their_removal(spark, ledger, tmp_path):
    schema = "id long, name string, email string, role string, is_active boolean, created_at timestamp, last_login timestamp"
    people = [(i, f"user {i}", f"u{i}@example.com", "Analyst", True, NOW, None) for i in (1, 2, 3)]
    assert ledger.users().count() == 0
    assert maintain.put_users(ledger, spark.createDataFrame(people, schema), 1)
    for batch, user in ((2, 1), (3, 2)):
        upload(ledger, [put(tmp_path / f"in{user}", f"{user}.csv", HEADER, f"2024-0{user}-01,1,0,1,A,0,1")], batch, user, NOW)
    changes = [(1, 1, "first", None, None), (1, 2, None, "Admin", None), (1, 3, None, None, False), (9, 4, "nobody", None, None)]
    frame = spark.createDataFrame(changes, "id long, seq long, name string, role string, is_active boolean")
    assert maintain.apply_user_changes(ledger, frame, 4) and not maintain.apply_user_changes(ledger, frame, 4)
    first = ledger.users().where("id = 1").first()
    assert (first.name, first.role, first.is_active, first.email) == ("first", "Admin", False, "u1@example.com")

    before = {(p.ym, p.bucket): p.attempt for p in ledger.state().pieces}
    assert maintain.remove_users(ledger, spark.createDataFrame([(1,), (1,)], "id long"), 5)
    assert sorted(r.id for r in ledger.users().collect()) == [2, 3]
    assert stored(ledger) == {("2024-01-01", "A"): (1, 1, None), ("2024-02-01", "A"): (1, 1, 2)}
    assert {r.filename: r.uploaded_by for r in ledger.upload_history().collect()} == {"1.csv": None, "2.csv": 2}
    after = {(p.ym, p.bucket): p.attempt for p in ledger.state().pieces}
    assert [key[0] for key in after if after[key] != before[key]] == ["2024-01"]
    # A new user with the old id owns what is uploaded from now on, and nothing before.
    assert maintain.put_users(ledger, spark.createDataFrame([people[0]], schema), 6)
    upload(ledger, [put(tmp_path / "again", "3.csv", HEADER, "2024-03-01,1,0,1,A,0,1")], 7, 1, NOW)
    assert {r.filename: r.uploaded_by for r in ledger.upload_history().collect()} == {"1.csv": None, "2.csv": 2, "3.csv": 1}
