from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import periodic_runs as op
from ledgerloom.llm import queries
from ledgerloom.llm.lcp_intervals import intervals, smaller_children, suffix_order

FOLDER = "/root/testdata/sf0.001"


def brute(words, at_least=24, times=3):
    """All longest stretches of every period; of those over the same words the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(at_least, times * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((start, length, q) for (start, length), q in out.items()), key=lambda run: (run[0], run[2]))


def random_documents(seed):
    chosen = random.Random(seed)
    for _ in range(chosen.choice([1, 3, 8])):
        n, k = chosen.choice([0, 1, 5, 30, 80, 200]), chosen.choice([1, 2, 3, 30])
        words = [chosen.randrange(k) for _ in range(n)]
        for _ in range(chosen.choice([0, 1, 2]) if n > 3 else 0):
            a, p = chosen.randrange(n), 1 + chosen.randrange(12)
            for i in range(a + p, min(n, a + chosen.randrange(100))):
                words[i] = words[i - p]
        yield np.array(words, np.int64)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[2] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("at_least,times", [(24, 3), (4, 2)])
def test_runs_match_brute_force(at_least, times):
    for seed in range(120):
        documents = list(random_documents(seed))
        assert op.find_runs(documents, at_least, times) == [brute(d.tolist(), at_least, times) for d in documents]


def test_texts_of_many_squares():
    fibonacci, following = [0], [0, 1]
    while len(following) < 900:
        fibonacci, following = following, following + fibonacci
    for words in (fibonacci, [0] * 700, [0, 1] * 200 + [0] * 60 + [1, 1, 0] * 40):
        assert op.find_runs([np.array(words)], 6, 2) == [brute(words, 6, 2)]


def test_suffix_order_and_intervals():
    texts = [b"mississippi", b"mississippi", b"aaaa", b"", b"abab"]
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    end = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order, rank, shared = suffix_order(symbols, owner, end)
    suffix = lambda i: (int(owner[i]), bytes(symbols[i : end[i]].astype(np.uint8)))
    assert [suffix(i) for i in order] == sorted(map(suffix, range(len(symbols))))
    assert (rank[order] == np.arange(len(order))).all()
    for r in range(1, len(order)):
        (o1, a), (o2, b) = suffix(order[r - 1]), suffix(order[r])
        common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert shared[r] == (common if o1 == o2 else 0)
    depth, first, last, parted = intervals(shared)
    for d, low, high in zip(depth, first, last):
        assert shared[low + 1 : high + 1].min() == d > shared[low] and (high + 1 == len(shared) or shared[high + 1] < d)
    interval, position = smaller_children(first, last, parted, np.ones(len(depth), bool))
    assert ((first[interval] <= position) & (position <= last[interval])).all()
    # All suffixes but those of the largest child.
    for k in range(len(depth)):
        cuts = [first[k], *[x for x in np.flatnonzero(parted == k)], last[k] + 1]
        children = [set(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        left = set(position[interval == k].tolist())
        assert len(left) == last[k] - first[k] + 1 - max(map(len, children))
        assert any(left == set(range(first[k], last[k] + 1)) - child for child in children)


def test_whole_table_against_brute_force_and_sql(spark):
    frame = queries.op12_periodic_runs(spark, FOLDER)
    own = sorted(map(tuple, frame.collect()))
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert own == sorted(expected(r.doc_id, r.text) for r in table.collect())
    assert sum(row[1] for row in own) > 0
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    sql = connection.sql(queries.ORACLE_SQL["op12_periodic_runs"]).select(*frame.columns)
    assert sorted(sql.fetchall()) == own


def test_edges(docs, monkeypatch):
    monkeypatch.setattr(op, "GROUP_WORDS", 50)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 20), (None, None), (4, "x " * 3000), (4, "x " * 3000)]
    rows += [(5, "é\x0bè   " * 30), (6, "one two"), (7, "c " * 23), (8, "c " * 24), (9, "1 2 3 " * 9 + "4")]
    rows += [(i, " ".join(map(str, range(40)))) for i in range(10, 80)]
    frame = op.report(docs(rows, clashing=True))
    assert sorted(map(tuple, frame.collect()), key=str) == sorted((expected(*row) for row in rows), key=str)
    assert op.report(docs([])).count() == 0


def test_runs_and_collapsed_texts(docs):
    rows = [(1, "go a  b " + "a b " * 12 + "stop  here"), (2, "nothing  repeats"), (3, None), (4, "na " * 30)]
    table = docs(rows, clashing=True)
    assert sorted(map(tuple, op.runs(table).collect())) == [(1, 1, 26, 2), (4, 0, 30, 1)]
    short = op.collapse(table)
    assert short.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in short.collect() if r.text) == [
        (1, "go a b stop here"), (2, "nothing  repeats"), (4, "na")
    ]
    assert op.collapse(docs([])).count() == 0
