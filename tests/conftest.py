from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.schema import ALERTS, BUSINESS_DATA  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Builds fact rows from (date, department, revenue, cost, expenses, profit, sales[, owner])."""
    from decimal import Decimal

    def build(*rows):
        data = []
        for number, row in enumerate(rows, start=1):
            date, department, *money = row[:6]
            sales = row[6] if len(row) > 6 else 1
            owner = row[7] if len(row) > 7 else None
            revenue, cost, expenses, profit = (Decimal(str(m)) for m in money)
            data.append(
                (number, dt.date.fromisoformat(date), revenue, cost, expenses, profit, department, sales,
                 dt.datetime(2024, 1, 1), owner)
            )
        return spark.createDataFrame(data, BUSINESS_DATA)

    return build


@pytest.fixture(scope="session")
def no_alerts(spark):
    return spark.createDataFrame([], ALERTS)
