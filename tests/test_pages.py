from __future__ import annotations

import datetime as dt

from ledgerloom.operators import listing


def test_pages_together_are_all_rows_in_order(facts):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i // 7) for i in range(50)]
    df = facts(*[(day.isoformat(), f"D{i % 9:02}{i}", 100, 1, 1, 98) for i, day in enumerate(days)])
    expected = [(r.id, r.date.isoformat()) for r in df.orderBy(df.date.desc(), "department", "id").collect()]
    found = []
    for page in range(1, 9):
        found += [(r.id, r.date) for r in listing.records_page(df, page, 8).collect()]
    assert found == expected
    assert listing.records_page(df, 0, 8).first().id == expected[0][0]


def test_page_size_is_a_documented_limit(facts):
    df = facts(*[("2024-01-01", f"D{i:03}", 1, 0, 0, 1) for i in range(130)])
    assert listing.records_page(df, 1, 500).count() == 100
    assert listing.records_page(df, 1, 500, max_per_page=500).count() == 130
    assert listing.records_page(df, 2, 500, max_per_page=120).count() == 10
    assert tuple(listing.page_info(df, 0, 500, max_per_page=120).first()) == (130, 2, 1)
    assert listing.records_page(df, 10, 100).count() == 0
