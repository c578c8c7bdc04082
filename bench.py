"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the cores. Each query's rows are fetched in full; after one warm-up run
the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.catalog import QUERIES  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINE = [
    "kpi_summary",
    "kpi_summary_filtered",
    "revenue_trend",
    "department_profitability",
    "monthly_growth",
    "monthly_summary_departments",
    "records_page",
    "user_activity",
    "user_recent_records",
    "owner_scoped_totals",
    "admin_statistics",
    "alerts_new",
    "upsert_last_wins",
    "ingest_file_status",
    "updates_applied",
    "report_records",
    "csv_ingest_roundtrip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores), app="bench")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(3):
            started = time.perf_counter()
            QUERIES[name](spark, folder).toArrow()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs[1:]), 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
