"""Report jobs: the sheets as folders of files.

The sheets of a report are made from one computation of its records, which is kept while
they are written: the joins and exchanges behind the records run once, not once a sheet
and once more to sample the sort's ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.operators.filters import Scope
from ledgerloom.schema import KEY, MEASURES

# Columns that sheets are made of; condensed facts count their records.
SHEET_COLUMNS = {"id", *KEY, *MEASURES, "records"}


@contextmanager
def _kept(facts: DataFrame, scope: Scope) -> Iterator[DataFrame]:
    """The records in scope, held by the executors, on disk if need be, while the block runs."""
    rows = scope.apply(facts)
    rows = rows.select(*[column for column in rows.columns if column in SHEET_COLUMNS]).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def write_report(facts: DataFrame, folder: str, scope: Scope = Scope(), file_format: str = "csv") -> dict[str, str]:
    """Writes the KPI, record and department sheets; returns their folders.

    The seven KPI lines are one file. Records are sorted newest first over all
    tasks by (date, department), so a single hot date is split too, and every
    task writes its own file.
    """
    folder = folder.rstrip("/")
    paths = {}
    with _kept(facts, scope) as rows:
        sheets = {
            "kpi_summary": reports.kpi_sheet(rows).coalesce(1).sortWithinPartitions("line"),
            "business_data": reports.records_sheet(rows).orderBy(F.col("date").desc(), "department"),
            "department_summary": reports.departments_sheet(rows).orderBy("department"),
        }
        for name, sheet in sheets.items():
            paths[name] = f"{folder}/{name}"
            sheet.write.mode("overwrite").format(file_format).option("header", "true").save(paths[name])
    return paths


def write_printable(facts: DataFrame, folder: str, scope: Scope = Scope()) -> dict[str, str]:
    """Writes the printable report's two tables of texts."""
    folder = folder.rstrip("/")
    paths = {}
    with _kept(facts, scope) as rows:
        sheets = {
            "key_performance_indicators": reports.printed_kpis(rows).select("line", "metric", "value").coalesce(1),
            "business_data_summary": reports.printed_records(rows),
        }
        for name, sheet in sheets.items():
            paths[name] = f"{folder}/{name}"
            sheet.write.mode("overwrite").option("header", "true").csv(paths[name])
    return paths
