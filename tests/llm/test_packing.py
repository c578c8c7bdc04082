from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing as op


@pytest.fixture(scope="module")
def expected_ids():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, texts, expected_ids, length=op.LENGTH):
    """Every id of every row is in one piece; sequences are gapless; returns the padding share.

    A sequence before the last is short by less than a run of ids.
    """
    wanted = defaultdict(int)
    for doc_id, text in texts:
        wanted[doc_id, tuple(expected_ids(text))] += 1
    sequences = defaultdict(list)
    by_document = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        by_document[p.doc_id].append(p)
    total = padding = 0
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at and size > 0
            at += size
        assert at <= length
        total += at
        padding += length - at if at & (at - 1) else 0
    for (doc_id, ids), copies in wanted.items():
        own = [p for p in by_document[doc_id] if p.doc_tokens == len(ids)]
        spans = defaultdict(int)
        for p in own:
            data = np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            if p.ids_crc32 == zlib.crc32(data):
                spans[p.start, p.start + p.length] += 1
        covered = np.zeros(len(ids), int)
        for (start, end), n in spans.items():
            covered[start:end] += n
        assert (covered == copies).all()
    assert total == sum(len(ids) * n for (_, ids), n in wanted.items())
    assert padding < length + op.RUN * len(sequences)
    return padding / max(total, 1)


def test_whole_table(spark, expected_ids):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    assert check(op.report(table).collect(), texts, expected_ids) < 0.02


def test_edges(docs, expected_ids):
    odd = ["  two  spaces ", "tab\there \n\n end ", " lead", " nb  sp", "a " * 3000, "x" * 9000, "<|endoftext|> it's we'll", "\x00é\U0001f600"]
    texts = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "none"), *enumerate(odd, start=10)]
    check(op.report(docs(texts, clashing=True)).collect(), texts, expected_ids)
    assert op.report(docs([])).count() == 0


def test_ids_on_demand(docs, expected_ids):
    texts = [(1, "some words to pack " * 400), (2, "more")]
    pieces = op.pack(docs(texts), length=256, with_ids=True).collect()
    check(pieces, texts, expected_ids, 256)
    for doc_id, text in texts:
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == doc_id)
        assert np.frombuffer(b"".join(ids for _, ids in own), np.uint16).tolist() == expected_ids(text)


def test_added_tokens_have_their_ids(docs):
    """As the tokenizers library has it at its defaults."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark} x", f"one two{mark}\n three  {mark}  ", f"{mark[:-1]} {mark.upper()} <{mark}>", f"some words {mark} " * 300]
    assert expected(texts[0])[:-1] == [64, 220, 50256, 275]
    encoder = op.Encoder(None)
    assert [encoder.ids(text).tolist() for text in texts] == [expected(text) for text in texts]
    rows = list(enumerate(texts))
    check(op.report(docs(rows)).collect(), rows, expected)


def test_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = op.hilbert(cells, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_checksums_combine():
    data = bytes(range(200))
    first, second = data[:100], data[100:164]
    assert op.joined_checksum(zlib.crc32(first), zlib.crc32(second), 16) == zlib.crc32(first + second)
    assert op.joined_checksum(zlib.crc32(first), zlib.crc32(second[:4]), 1) == zlib.crc32(first + second[:4])
