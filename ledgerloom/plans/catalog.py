"""Named queries over a folder of input tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.display import short_date
from ledgerloom.functions.headers import normalise
from ledgerloom.functions.measures import margin, moment, performance_class
from ledgerloom.operators import admin, alerts, departments, ingest, kpis, listing, merge, quality, reports, rollup, trends
from ledgerloom.operators.filters import Scope, active, by_id, since, unread, visible_to
from ledgerloom.plans import maintain, procedures
from ledgerloom.plans.report import write_printable, write_report
from ledgerloom.plans.upload import upload
from ledgerloom.schema import BUSINESS_DATA, MEASURES, UPLOAD_COLUMNS, UPLOAD_HISTORY
from ledgerloom.session import configure, work_folder
from ledgerloom.sources import adapter
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import polling, uploads

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.datetime(2024, 1, 31)
LAYOUT_CHANGE = dt.date(2024, 1, 16)
SCOPE = Scope(start="1997-01-15", end="1999-06-30", department="2-HIGH")
MONTH = "1998-03"
VIEWER = 7
RECORD_ID = 103291


def _facts(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(adapter.business_data(configure(spark), folder))


def _alerts(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(adapter.alerts(configure(spark), folder))


def _history(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(adapter.upload_history(configure(spark), folder))


def _users(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(adapter.users(configure(spark), folder))


def _record_columns(df: DataFrame) -> DataFrame:
    """Fact rows in the form results are compared in."""
    return df.select(
        "id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "department",
        *[F.col(m).cast("double").alias(m) for m in MEASURES[:4]],
        F.col("sales_volume").cast("bigint").alias("sales_volume"),
        F.col("created_by").cast("string").alias("owner"),
    )


def kpi_summary_owner(spark: SparkSession, folder: str) -> DataFrame:
    facts, users = adapter.business_data(configure(spark), folder), adapter.users(spark, folder)
    return kpis.kpi_summary(visible_to(facts, users, VIEWER))


def proc_monthly_kpis(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapter.business_data(configure(spark), folder)
    return procedures.monthly_kpis(spark, facts, 1998, 3, "2-HIGH")


def proc_monthly_kpis_all(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapter.business_data(configure(spark), folder)
    return procedures.monthly_kpis(spark, facts, 1998, 3)


def proc_department_performance(spark: SparkSession, folder: str) -> DataFrame:
    return procedures.department_performance(spark, adapter.business_data(configure(spark), folder))


def view_monthly_summary(spark: SparkSession, folder: str) -> DataFrame:
    return procedures.monthly_summary(spark, adapter.business_data(configure(spark), folder))


def view_department_summary(spark: SparkSession, folder: str) -> DataFrame:
    return procedures.department_summary(spark, adapter.business_data(configure(spark), folder))


def user_activity(spark: SparkSession, folder: str) -> DataFrame:
    return admin.user_activity(
        adapter.users(configure(spark), folder),
        adapter.upload_history(spark, folder),
        adapter.business_data(spark, folder),
    )


def admin_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return admin.statistics(
        adapter.users(configure(spark), folder),
        adapter.upload_history(spark, folder),
        adapter.business_data(spark, folder),
        AS_OF,
    )


def owner_scoped_totals(spark: SparkSession, folder: str) -> DataFrame:
    return admin.owner_scoped_totals(adapter.users(configure(spark), folder), adapter.business_data(spark, folder))


def uploads_with_owner(spark: SparkSession, folder: str) -> DataFrame:
    history = adapter.upload_history(configure(spark), folder)
    joined = admin.with_owner(history, adapter.users(spark, folder), "uploaded_by")
    return joined.select("id", "filename", "uploaded_by", "owner_name", "owner_role")


def totals_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return admin.totals_by_role(adapter.business_data(configure(spark), folder), adapter.users(spark, folder))


def uploads_visible(spark: SparkSession, folder: str) -> DataFrame:
    history, users = adapter.upload_history(configure(spark), folder), adapter.users(spark, folder)
    return listing.latest_uploads(visible_to(history, users, VIEWER, "uploaded_by"))


def alerts_generated(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.evaluate(adapter.business_data(configure(spark), folder)).withColumn("value", F.round("value", 2))


def alerts_new(spark: SparkSession, folder: str) -> DataFrame:
    facts, existing = adapter.business_data(configure(spark), folder), adapter.alerts(spark, folder)
    return alerts.new_alerts(facts, existing, AS_OF).select("type", "message", "severity", "department", "is_read")


def alerts_mark_read(spark: SparkSession, folder: str) -> DataFrame:
    stored = adapter.alerts(configure(spark), folder)
    marked = since(stored, "created_at", AS_OF).select("id")
    return alerts.mark_read(stored, marked).select("id", "type", "department", "is_read")


def alerts_mark_all_read(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.mark_all_read(adapter.alerts(configure(spark), folder)).select("id", "type", "department", "is_read")


def upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    current = adapter.business_data(configure(spark), folder)
    keys = ingest.last_per_key(adapter.order_batch(spark, folder))
    owner, now = F.lit(VIEWER).cast("bigint"), moment(AS_OF, "timestamp_ntz")
    return _record_columns(merge.upsert(current, keys, 1, now, owner))


def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    current = adapter.business_data(configure(spark), folder)
    keys = ingest.first_per_key(adapter.order_batch(spark, folder))
    owner, now = F.lit(None).cast("bigint"), moment(AS_OF, "timestamp_ntz")
    return _record_columns(merge.insert_if_absent(current, keys, 1, now, owner))


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.validate(adapter.raw_uploads(configure(spark), folder))


def ingest_accept(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.accepted(_validated(spark, folder)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return rows.select("filename", "line", "date", "department", *[F.col(m).cast("double").alias(m) for m in MEASURES])


def ingest_merged(spark: SparkSession, folder: str) -> DataFrame:
    keys = ingest.last_per_key(ingest.accepted(_validated(spark, folder)))
    return keys.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "department",
        *[F.col(m).cast("double").alias(m) for m in MEASURES],
        "first_seq",
    )


def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.rejected(_validated(spark, folder)).select("line", "raw", "error")


def ingest_file_status(spark: SparkSession, folder: str) -> DataFrame:
    raw = adapter.raw_uploads(configure(spark), folder)
    files = raw.select("file_no", "filename", F.lit(None).cast("string").alias("problem")).distinct()
    validated = ingest.validate(raw)
    new_keys = ingest.last_per_key(ingest.accepted(validated))
    outcomes = ingest.file_outcomes(files, ingest.row_counts(validated), new_keys)
    return outcomes.drop("file_no", "problem")


def ingest_error_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.error_summaries(ingest.rejected(_validated(spark, folder)))


def updates_applied(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapter.business_data(configure(spark), folder)
    return _record_columns(merge.update_records(facts, adapter.record_changes(spark, folder)))


def updates_rejected(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapter.business_data(configure(spark), folder)
    combined = merge.combine_changes(adapter.record_changes(spark, folder), merge.EDITABLE)
    refused = merge.colliding_changes(facts, combined)
    return refused.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def deletes_applied(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapter.business_data(configure(spark), folder)
    moved = adapter.record_changes(spark, folder).filter(F.col("date").isNotNull())
    return _record_columns(merge.delete_by_id(facts, moved.select("id")))


def users_updated(spark: SparkSession, folder: str) -> DataFrame:
    users = adapter.users(configure(spark), folder)
    return merge.update_users(users, adapter.user_changes(spark, folder)).select("id", "name", "email", "role", "is_active")


def users_removed(spark: SparkSession, folder: str) -> DataFrame:
    users, facts = adapter.users(configure(spark), folder), adapter.business_data(spark, folder)
    removed = users.filter(~F.col("is_active"))
    return merge.release_owner(facts, removed.select("id"), "created_by").select(
        "id", F.col("created_by").cast("string").alias("owner")
    )


def users_remaining(spark: SparkSession, folder: str) -> DataFrame:
    users = adapter.users(configure(spark), folder)
    removed = users.filter(~F.col("is_active"))
    return merge.delete_by_id(users, removed).select("id", "name", "role")


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_checks(
        adapter.business_data(configure(spark), folder),
        adapter.users(spark, folder),
        adapter.upload_history(spark, folder),
    )


LAYOUTS = [
    ["Date", "Revenue", "Cost", "Expenses", "Profit", "Department", "Sales_Volume"],
    ["date", "REVENUE", "Cost", "Profit", "department", "Expenses", " Sales Volume"],
]


def _written_csv(spark: SparkSession, rows: DataFrame, titles: list[str], extension: str = "csv") -> str:
    """Input for the upload queries: a folder with one CSV file per ``filename``, in order of ``seq``.

    Every file is written by one task, as an upload is, and then gets its name.
    """
    path = work_folder(spark, "uploads")
    columns = {normalise(t): c for t, c in UPLOAD_COLUMNS.items()}
    named = [F.col(columns[normalise(title)]).alias(title) for title in titles]
    (
        rows.repartitionByRange("filename")
        .sortWithinPartitions("filename", "seq")
        .select(F.col("filename").alias("_file"), *named)
        .write.partitionBy("_file")
        .option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in system.globStatus(hadoop.Path(f"{path}/_file=*/part-*")):
        stem = part.getPath().getParent().getName().removeprefix("_file=").rsplit(".", 1)[0]
        system.rename(part.getPath(), hadoop.Path(f"{path}/{stem}.{extension}"))
    return path


def _written_uploads(spark: SparkSession, folder: str) -> list[str]:
    """The raw uploads as CSV files, one per day: the days before the change in one column order,
    the others in another."""
    raw = adapter.raw_uploads(spark, folder)
    early = F.coalesce(F.col("file_no") < F.unix_date(F.lit(LAYOUT_CHANGE)), F.lit(False))
    return [_written_csv(spark, raw.filter(period), layout) for period, layout in zip((early, ~early), LAYOUTS)]


def _uploaded(spark: SparkSession, folder: str) -> Ledger:
    ledger = Ledger.create(spark, work_folder(configure(spark), "ledger"), buckets=2)
    upload(ledger, _written_uploads(spark, folder), 1, VIEWER, AS_OF)
    return ledger


def _streamed(spark: SparkSession, folder: str) -> Ledger:
    ledger = Ledger.create(spark, work_folder(configure(spark), "ledger"), buckets=2)
    for path in _written_uploads(spark, folder):
        # The files are written in parallel, so their names say the order, not their times.
        query = uploads.start(
            ledger, path, work_folder(spark, "progress"), VIEWER, clock=lambda: AS_OF, order="name"
        )
        query.awaitTermination()
    return ledger


def _stored(spark: SparkSession, folder: str) -> Ledger:
    """The fact table, the users and the uploads as the first batch of a ledger."""
    ledger = Ledger.create(spark, work_folder(configure(spark), "ledger"), buckets=1)
    attempt = ledger.begin()
    pieces = attempt.write_version(adapter.business_data(spark, folder))
    attempt.write_users(adapter.users(spark, folder))
    history = adapter.upload_history(spark, folder)
    attempt.log("upload_history", history.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in UPLOAD_HISTORY]))
    attempt.publish(pieces)
    return ledger


def csv_ingest_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(_uploaded(spark, folder).read())


def csv_ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _uploaded(spark, folder).rejects().select("filename", "line", "raw", "error")


def csv_ingest_history(spark: SparkSession, folder: str) -> DataFrame:
    """The logged files, with their outcome and first errors."""
    return _uploaded(spark, folder).upload_history().select(
        "id", "filename", "records_count", "status", "error_message", F.col("uploaded_by").cast("string").alias("owner")
    )


def csv_ingest_failed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that cannot be used, beside usable ones: by event type a column is missing, two columns
    stand for one, the file has another extension, or it is a workbook by name."""
    raw = adapter.raw_uploads(configure(spark), folder)
    titles = LAYOUTS[0]
    kinds = {
        "click": ([t for t in titles if t != "Expenses"], "csv"),
        "view": ([*titles, "Sales"], "csv"),
        "error": (titles, "txt"),
        "signup": (titles, "xlsx"),
        "purchase": (titles, "CSV"),
    }
    kind = F.trim("department")
    sources = []
    for name, (layout, extension) in kinds.items():
        rows = raw.filter(kind == name).withColumn("filename", F.concat(F.lit(f"{name}_"), F.col("filename")))
        sources.append(_written_csv(spark, rows, layout, extension))
    ledger = Ledger.create(spark, work_folder(spark, "ledger"), buckets=1)
    upload(ledger, sources, 1, VIEWER, AS_OF)
    failed = F.when(F.col("status") == "failed", F.col("error_message"))
    return ledger.upload_history().select("filename", "status", "records_count", failed.alias("problem"))


def ingest_date_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads whose files write day and month in different orders, and what became of every line."""
    validated = ingest.validate(adapter.dated_uploads(configure(spark), folder))
    date_error = F.filter("errors", lambda e: e.contains(" date "))
    return validated.select(
        "filename", "line", F.date_format("date", "yyyy-MM-dd").alias("date"), F.get(date_error, F.lit(0)).alias("problem")
    )


def seed_load(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as a seed load: strict texts, first row wins, no owner."""
    ledger = Ledger.create(spark, work_folder(configure(spark), "ledger"), buckets=2)
    upload(ledger, _written_uploads(spark, folder), 1, None, AS_OF, seed=True)
    return _record_columns(ledger.read())


def seed_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """A seed load of files that have dates and revenues only."""
    ledger = Ledger.create(spark, work_folder(configure(spark), "ledger"), buckets=1)
    raw = adapter.raw_uploads(spark, folder)
    upload(ledger, [_written_csv(spark, raw, ["Date", "Revenue"])], 1, None, AS_OF, seed=True)
    return _record_columns(ledger.read())


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(_streamed(spark, folder).read())


def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).alerts().select("type", "message", "severity", "department", "is_read")


def stream_alerts_poll(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of a stream over commits: one poll after the facts were stored, one after all
    revenues of two departments were edited to a cent, without any upload."""
    ledger = _stored(spark, folder)
    progress = work_folder(spark, "polls")
    polling.start(ledger, progress, clock=lambda: AS_OF).awaitTermination()
    edited = ledger.read().filter(F.col("department").isin("1-URGENT", "2-HIGH")).select("id", F.lit(0).alias("seq"))
    unchanged = [F.lit(None).cast(BUSINESS_DATA[c].dataType).alias(c) for c in merge.EDITABLE if c != "revenue"]
    changes = edited.select("*", F.lit("0.01").cast("decimal(15,2)").alias("revenue"), *unchanged)
    maintain.apply_updates(ledger, changes, ledger.last_batch() + 1, None)
    polling.start(ledger, progress, clock=lambda: AS_OF + dt.timedelta(minutes=1)).awaitTermination()
    late = F.col("created_at") > moment(AS_OF)
    return ledger.alerts().select(late.alias("second_poll"), "type", "severity", "department", "is_read")


def ledger_updates(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _stored(spark, folder)
    maintain.apply_updates(ledger, adapter.record_changes(spark, folder), 2, AS_OF)
    return _record_columns(ledger.read())


def ledger_deletes(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _stored(spark, folder)
    moved = adapter.record_changes(spark, folder).filter(F.col("date").isNotNull())
    maintain.apply_deletes(ledger, moved.select("id"), 2, AS_OF)
    return _record_columns(ledger.read())


def ledger_users_updated(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _stored(spark, folder)
    maintain.apply_user_changes(ledger, adapter.user_changes(spark, folder), ledger.last_batch() + 1)
    return ledger.users().select("id", "name", "email", "role", "is_active")


def ledger_users_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Inactive users removed: the users, records and uploads that are left, with their owners."""
    ledger = _stored(spark, folder)
    removed = ledger.users().filter(~F.col("is_active")).select("id")
    maintain.remove_users(ledger, removed, ledger.last_batch() + 1)
    owner = lambda column: F.col(column).cast("string").alias("owner")
    users = ledger.users().select(F.lit("user").alias("kind"), "id", owner("id"))
    records = ledger.read().select(F.lit("record").alias("kind"), "id", owner("created_by"))
    return users.unionByName(records).unionByName(
        ledger.upload_history().select(F.lit("upload").alias("kind"), "id", owner("uploaded_by"))
    )


def ledger_kpis_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """KPIs of the stored table; files of other months and buckets are not opened."""
    return kpis.kpi_summary(_stored(spark, folder).scoped(SCOPE))


def ledger_trend_cells(spark: SparkSession, folder: str) -> DataFrame:
    return trends.revenue_trend(_stored(spark, folder).cells())


def ledger_alerts_marked(spark: SparkSession, folder: str) -> DataFrame:
    """A stored alert run, of which the department alerts are marked as read, and a second run."""
    ledger = _stored(spark, folder)
    maintain.run_alerts(ledger, 2, AS_OF)
    maintain.mark_alerts_read(ledger, ledger.alerts().filter("type = 'low_margin'").select("id"), 3)
    maintain.run_alerts(ledger, 4, AS_OF + dt.timedelta(hours=1))
    return ledger.alerts().select("type", "message", "severity", "department", "is_read")


def sql_monthly_kpis(spark: SparkSession, folder: str) -> DataFrame:
    procedures.register_functions(spark, adapter.business_data(configure(spark), folder))
    return spark.sql("SELECT * FROM get_monthly_kpis(1998, 3, NULL)")


def sql_department_performance(spark: SparkSession, folder: str) -> DataFrame:
    procedures.register_functions(spark, adapter.business_data(configure(spark), folder))
    return spark.sql("SELECT * FROM get_department_performance()")


def records_rated(facts: DataFrame) -> DataFrame:
    """Row margins as the record list shows them: one decimal, with their class."""
    rate = margin(F.col("profit"), F.col("revenue"), 1)
    return facts.select("id", rate.alias("row_margin"), performance_class(rate).alias("css_class"))


def user_login_dates(users: DataFrame) -> DataFrame:
    return users.select("id", short_date(F.col("last_login")).alias("last_login"))


def _written_report(spark: SparkSession, folder: str) -> dict[str, str]:
    return write_report(adapter.business_data(configure(spark), folder), work_folder(spark, "report"))


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    schema = "date string, department string, revenue double, cost double, expenses double, profit double, sales_volume long, row_margin double"
    return spark.read.schema(schema).option("header", "true").csv(_written_report(spark, folder)["business_data"])


def report_files_departments(spark: SparkSession, folder: str) -> DataFrame:
    schema = "department string, revenue double, cost double, profit double, sales_volume long, profit_margin double"
    return spark.read.schema(schema).option("header", "true").csv(_written_report(spark, folder)["department_summary"])


def report_files_kpi(spark: SparkSession, folder: str) -> DataFrame:
    schema = "line long, metric string, value double"
    return spark.read.schema(schema).option("header", "true").csv(_written_report(spark, folder)["kpi_summary"])


def report_printed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The printable report's record table as it was written."""
    paths = write_printable(adapter.business_data(configure(spark), folder), work_folder(spark, "printed"))
    schema = "date string, department string, revenue string, cost string, profit string, sales string"
    return spark.read.schema(schema).option("header", "true").csv(paths["business_data_summary"])


QUERIES: dict[str, Query] = {
    "kpi_summary": _facts(kpis.kpi_summary),
    "kpi_summary_filtered": _facts(lambda df: kpis.kpi_summary(df, SCOPE)),
    "kpi_summary_owner": kpi_summary_owner,
    "kpi_summary_cells": _facts(lambda df: kpis.kpi_summary(rollup.cells(df))),
    "kpi_month": _facts(lambda df: kpis.month_kpis(df, MONTH)),
    "revenue_trend": _facts(trends.revenue_trend),
    "revenue_trend_filtered": _facts(lambda df: trends.revenue_trend(df, SCOPE)),
    "sales_trend": _facts(trends.sales_trend),
    "margin_trend": _facts(trends.margin_trend),
    "monthly_growth": _facts(trends.monthly_growth),
    "monthly_growth_by_department": _facts(trends.monthly_growth_by_department),
    "department_distribution": _facts(departments.distribution),
    "department_profitability": _facts(departments.profitability),
    "department_profitability_cells": _facts(lambda df: departments.profitability(rollup.cells(df))),
    "department_labels": _facts(departments.labels),
    "top_worst_department": _facts(departments.top_and_worst),
    "month_breakdown": _facts(lambda df: departments.month_breakdown(df, MONTH)),
    "monthly_summary_departments": _facts(departments.revenue_shares),
    "departments": _facts(departments.names),
    "proc_monthly_kpis": proc_monthly_kpis,
    "proc_monthly_kpis_all": proc_monthly_kpis_all,
    "proc_department_performance": proc_department_performance,
    "view_monthly_summary": view_monthly_summary,
    "view_department_summary": view_department_summary,
    "records_page": _facts(lambda df: listing.records_page(df, page=3)),
    "records_page_deep": _facts(lambda df: listing.records_page(df, page=40, per_page=70)),
    "records_after": _facts(lambda df: listing.records_after(df, "1998-03-15", "2-HIGH")),
    "records_page_info": _facts(lambda df: listing.page_info(df, page=3)),
    "record_by_id": _facts(lambda df: listing.record_projection(by_id(df, RECORD_ID))),
    "users_list": _users(listing.user_projection),
    "users_active": _users(lambda df: listing.user_projection(active(df))),
    "users_recent_logins": _users(lambda df: listing.user_projection(since(df, "last_login", AS_OF, days=1))),
    "user_activity": user_activity,
    "admin_statistics": admin_statistics,
    "owner_scoped_totals": owner_scoped_totals,
    "uploads_with_owner": uploads_with_owner,
    "totals_by_role": totals_by_role,
    "user_recent_records": _facts(listing.recent_records_per_user),
    "user_recent_uploads": _history(listing.recent_uploads_per_user),
    "user_records": _facts(lambda df: listing.recent_records_of(df, VIEWER)),
    "user_uploads": _history(lambda df: listing.recent_uploads_of(df, VIEWER)),
    "upload_history_latest": _history(listing.latest_uploads),
    "uploads_visible": uploads_visible,
    "upload_status_counts": _history(listing.upload_status_counts),
    "alerts_generated": alerts_generated,
    "alerts_new": alerts_new,
    "alerts_latest": _alerts(listing.latest_alerts),
    "alerts_latest_unread": _alerts(lambda df: listing.latest_alerts(df, unread_only=True)),
    "alerts_first_five": _alerts(lambda df: listing.latest_alerts(df, unread_only=True, limit=5)),
    "alerts_unread": _alerts(lambda df: listing.alert_projection(unread(df))),
    "alerts_unread_count": _alerts(listing.unread_count),
    "alerts_mark_read": alerts_mark_read,
    "alerts_mark_all_read": alerts_mark_all_read,
    "upsert_last_wins": upsert_last_wins,
    "insert_if_absent": insert_if_absent,
    "ingest_accept": ingest_accept,
    "ingest_merged": ingest_merged,
    "ingest_rejects": ingest_rejects,
    "ingest_file_status": ingest_file_status,
    "ingest_error_summary": ingest_error_summary,
    "updates_applied": updates_applied,
    "updates_rejected": updates_rejected,
    "deletes_applied": deletes_applied,
    "users_updated": users_updated,
    "users_removed": users_removed,
    "users_remaining": users_remaining,
    "quality_checks": quality_checks,
    "report_kpi": _facts(reports.kpi_sheet),
    "report_records": _facts(reports.records_sheet),
    "report_departments": _facts(reports.departments_sheet),
    "report_display_kpis": _facts(reports.printed_kpis),
    "report_display_rows": _facts(reports.printed_records),
    "report_files": report_files,
    "report_files_departments": report_files_departments,
    "csv_ingest_roundtrip": csv_ingest_roundtrip,
    "csv_ingest_rejects": csv_ingest_rejects,
    "csv_ingest_history": csv_ingest_history,
    "seed_load": seed_load,
    "stream_ingest": stream_ingest,
    "stream_alerts": stream_alerts,
    "csv_ingest_failed_files": csv_ingest_failed_files,
    "seed_defaults": seed_defaults,
    "ingest_date_orders": ingest_date_orders,
    "stream_alerts_poll": stream_alerts_poll,
    "ledger_updates": ledger_updates,
    "ledger_deletes": ledger_deletes,
    "ledger_users_updated": ledger_users_updated,
    "ledger_users_removed": ledger_users_removed,
    "ledger_kpis_scoped": ledger_kpis_scoped,
    "ledger_trend_cells": ledger_trend_cells,
    "ledger_alerts_marked": ledger_alerts_marked,
    "sql_monthly_kpis": sql_monthly_kpis,
    "sql_department_performance": sql_department_performance,
    "growth_directions": _facts(trends.growth_directions),
    "records_rated": _facts(records_rated),
    "user_login_dates": _users(user_login_dates),
    "report_files_kpi": report_files_kpi,
    "report_files_printed": report_printed_rows,
}
