from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import repeats as op
from ledgerloom.llm.suffix_array import repeated_windows, suffix_array


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=400, deadline=None)
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_long_strings():
    for symbols in ([1] * 5000, list(range(5000)), list(range(5000, 0, -1)), [1, 2] * 2500, [2, 1, 1] * 1500):
        expected = sorted(range(len(symbols)), key=lambda i: symbols[i : i + 60] if len(set(symbols)) > 50 else symbols[i:])
        assert suffix_array(symbols) == expected


def test_windows_of_texts():
    random.seed(9)
    words = ["the", "and", "Éa", "x", "a", "bb", " ", "\n", "lorem", "ipsum.", "of"]
    for _ in range(300):
        length = random.choice([5, 12, 30])
        base = " ".join(random.choice(words) for _ in range(30)).encode()
        texts = []
        for _ in range(random.randrange(1, 8)):
            at = random.randrange(len(base))
            text = bytearray(base[at : at + length + random.randrange(20)])
            if text and random.random() < 0.5:
                text[random.randrange(len(text))] = random.choice(b"abx ")
            if len(text) >= length:
                texts.append(bytes(text))
        if texts:
            starts = [len(t) - length + 1 for t in texts]
            count = Counter(t[i : i + length] for t, n in zip(texts, starts) for i in range(n))
            expected = [[count[t[i : i + length]] > 1 for i in range(n)] for t, n in zip(texts, starts)]
            assert [flags.tolist() for flags in repeated_windows(texts, starts, length)] == expected


def brute(rows, length=op.LENGTH):
    texts = [(text or "").encode() for _, text in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), text in zip(rows, texts):
        covered = [False] * len(text)
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        runs = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        kept = bytes(b for b, c in zip(text, covered) if not c)
        out.append((doc_id, len(text), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    random.seed(6)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(90), text(30)
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 199), (5, "y" * 200), (6, "y" * 200), (7, "z" * 450), (8, "ab" * 300)]
    rows += [(i, text(20) + shared[i : 400 + i] + text(15) + line * (i % 3)) for i in range(10, 30)]
    rows += [(40, shared), (40, shared), (None, shared[:260]), (41, text(4000)), (42, shared[:199]), (43, shared[100:299])]
    return rows


@pytest.mark.parametrize("most,chunk", [(op.MOST_CLASSES, op.CHUNK), (1, 57)])
def test_matches_brute_force(docs, monkeypatch, most, chunk):
    monkeypatch.setattr(op, "MOST_CLASSES", most)
    rows = corpus()
    found = [tuple(r) for r in op.report(docs(rows, clashing=True)).collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)
    # Chunks cut stretches, never windows.
    monkeypatch.setattr(op, "CHUNK", chunk)
    for _, text in rows:
        data = (text or "").encode()
        parts = [(s, n) for part in op.stretches(data) for s, n in zip(part[0].tolist(), part[1].tolist())]
        assert [i for s, n in parts for i in range(s, s + n)] == list(range(len(data) - op.LENGTH + 1))


def test_removal_keeps_columns(docs):
    rows = corpus()
    table = docs(rows, clashing=True)
    out = op.remove(table)
    assert out.columns == table.columns
    kept = {(r.doc_id, len((r.text or "").encode())) for r in out.where("doc_id IS NOT NULL").collect()}
    assert {(i, n - gone) for i, n, gone, _, _ in brute(rows) if i is not None and gone == n} <= kept
    assert op.report(docs([])).count() == 0


def test_stretches_of_many_texts_at_once(monkeypatch):
    texts = [(text or "").encode() for _, text in corpus()]
    apart = [(i, *row) for i, text in enumerate(texts) for part in op.stretches(text) for row in zip(*(c.tolist() for c in part))]
    for block in (1, 900, 10**6):
        monkeypatch.setattr(op, "BLOCK", block)
        parts = list(op._found(texts))
        columns = ("owner", "start", "count", "anchor", "whole")
        assert [row for p in parts for row in zip(*(getattr(p, c).tolist() for c in columns))] == apart


def test_only_stretches_with_half_a_window_in_common_are_sorted(docs, monkeypatch):
    random.seed(4)
    words = ["government of ", "the population ", "in accordance ", "with respect to ", "as mentioned "]
    text = lambda n: "".join(random.choice(words) for _ in range(n))
    seen = []
    sort = op._by_suffix_arrays
    monkeypatch.setattr(op, "_by_suffix_arrays", lambda pieces: seen.append(pieces.count()) or sort(pieces))
    rows = [(i, text(40)) for i in range(30)]
    assert [tuple(r) for r in op.report(docs(rows)).orderBy("doc_id").collect()] == brute(rows)
    assert seen == [0]
    # Passages of a window, or a byte less, at any distance from their anchors.
    for i in range(30, 90):
        passage = rows[i % 30][1][i : i + op.LENGTH - i % 2]
        rows.append((i, text(random.randrange(12)) + "#" + passage + "#" + text(random.randrange(12))))
    found = [tuple(r) for r in op.report(docs(rows)).orderBy("doc_id").collect()]
    assert found == brute(rows) and seen[1] > 0
