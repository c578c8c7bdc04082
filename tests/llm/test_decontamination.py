from __future__ import annotations

import hashlib
import re

import pytest

from ledgerloom.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(text, benchmark, window=13):
    own, hit, items = words(text), set(), set()
    for item, item_text in benchmark:
        its = words(item_text)
        n = min(window, len(its))
        for s in range(len(its) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == its[s : s + n]:
                    hit.update(range(at, at + n))
                    items.add(str(item))
    ids = ",".join(sorted(items))
    return (
        len(own),
        len(hit),
        len(items),
        hashlib.sha256(ids.encode()).hexdigest(),
        bool(hit) and 20 * len(hit) >= len(own),
    )


LONG = " ".join(f"word{i}" for i in range(40))
ITEMS = [(1, LONG), (10, LONG[:200]), (2, "Two words"), (3, "Ünï"), (4, None), (5, ""), (6, "!!"), (2, "Two words")]
TEXTS = [
    (1, None),
    (2, ""),
    (3, "..."),
    (4, "before " + LONG.upper() + " after"),
    (5, "one two WORDS ünï Ünï"),
    (6, "x " * 100 + "two-words"),
    (6, "x " * 100 + "two-words"),
    (7, " ".join(f"word{i}" for i in range(12))),
    (None, "two words two words"),
    (8, "clean text " * 3000 + " ".join(f"word{i}" for i in range(5, 18))),
    (9, "Ünï"),
]


@pytest.mark.parametrize("limit, bitmap", [(op.BROADCAST_WINDOWS, op.BITMAP_WORDS), (0, op.BITMAP_WORDS), (0, 1)])
def test_matches_brute_force(spark, docs, limit, bitmap):
    """A bitmap of 64 bits lets many wrong places through; the rows stay the same."""
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = op.scan(docs(TEXTS, clashing=True), benchmark, broadcast_windows=limit, bitmap_words=bitmap)
    rows = [
        (r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated)
        for r in found.collect()
    ]
    expected = [(i, *brute(text, ITEMS)) for i, text in TEXTS]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.report(docs([]), none).count() == 0
    clean = op.report(docs([(1, "some words")]), none).first()
    assert (clean.n_words, clean.n_hit, clean.contaminated) == (2, 0, False)


def test_removal_keeps_everything_else(spark, docs):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    table = docs([(1, "Keep, Alpha-beta GAMMA; this. delta"), (2, "clean"), (3, None), (None, "delta!")], clashing=True)
    kept = op.remove_spans(table, benchmark)
    assert kept.columns == table.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Keep, this. ", 2: "clean", 3: None, None: ""}
    clean = op.drop_contaminated(table, benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert clean.columns == table.columns


def test_no_python_in_the_plan(spark, docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = op.report(docs(TEXTS), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_many_windows_shuffle_no_texts(spark, docs):
    """Beyond the bound, no shuffle writes the words of a text, and the bitmap stays within its size."""
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = op.scan(docs(TEXTS), benchmark, broadcast_windows=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" in plan
    joins = [line for line in plan.splitlines() if "Join" in line and "key" in line]
    assert joins
    below = plan.splitlines()[plan.splitlines().index(joins[0]) + 1]
    assert "found#" in below and not re.search("(?<!n_)words#", below)
    windows = op.item_windows(benchmark)
    for size in (1, 4, op.BITMAP_WORDS):
        assert op._lead_bitmap(windows, size).count() <= min(size, windows.count())
