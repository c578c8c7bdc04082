from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment as op
from ledgerloom.llm import queries
from ledgerloom.llm.packing import byte_of_symbol

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "two  spaces", " lead", "end ", "tab\there \n\n end", "a\nb c", " nb sp 　x", "a " * 3000, "x" * 3000,
    "<|endoftext|> it's we'll </s> <s> <0x41>", "\x00é\U0001f600 ​ é", "under▁score here", "some more words un▁known and a few after it", "A", " ", "ab ab ab", "ﬁ ½",
]


@pytest.fixture(scope="module")
def plain():
    """(A ids, B ids, A bytes, B bytes) of a text, by the two libraries on whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spelled = byte_of_symbol()

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(spelled[s] for s in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        return ids_a, ids_b, bytes_a, bytes_b

    return encode


def brute(rows, encode):
    """The contract, byte by byte."""
    documents, count = [], Counter()
    for doc_id, text in rows:
        a, b, bytes_a, bytes_b = encode(text) if text else ([], [], [], [])
        data = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            documents.append((doc_id, [], [], [], []))
            continue
        owner_a = np.repeat(np.arange(len(a)), [len(x) for x in bytes_a])
        owner_b = np.repeat(np.arange(len(b)), [len(x) for x in bytes_b])
        pairs = sorted(set(zip(owner_a.tolist(), owner_b.tolist())))
        ends = sorted(set(np.cumsum([len(x) for x in bytes_a])) & set(np.cumsum([len(x) for x in bytes_b])))
        groups, start = [], 0
        for end in ends:
            own = [sorted(set(o[start:end].tolist())) for o in (owner_a, owner_b)]
            groups.append(",".join(str(a[i]) for i in own[0]) + "|" + ",".join(str(b[j]) for j in own[1]))
            start = end
        links = [(a[i], b[j]) for i, j in pairs]
        count.update(set(links))
        documents.append((doc_id, a, b, groups, links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, a, b, groups, links in documents:
        n_best, total = sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), n_best, total, digest))
    return out, count


def test_whole_table_against_brute_force(spark, plain):
    frame = queries.op11_alignment(spark, FOLDER)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    expected, _ = brute(rows, plain)
    assert sorted(map(tuple, frame.collect())) == sorted(expected)
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("remembered,rows_per_block", [(150_000, 4_000), (3, 4)])
def test_edges(docs, plain, monkeypatch, remembered, rows_per_block):
    monkeypatch.setattr(op, "REMEMBERED", remembered)
    monkeypatch.setattr(op, "BLOCK_ROWS", rows_per_block)
    rows = [(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "same words, other"), *enumerate(ODD, start=10)]
    rows += [(100 + i, f"copied text {i % 3} zvorblex") for i in range(40)]
    expected, count = brute(rows, plain)
    assert sorted(map(tuple, op.report(docs(rows, clashing=True)).collect()), key=str) == sorted(expected, key=str)
    assert op.report(docs([])).count() == 0
    assert {(r.a, r.b): r.documents for r in op.pair_counts(docs(rows)).collect()} == dict(count)


def test_groups_on_demand(docs, plain):
    rows = [(i, text) for i, text in enumerate(ODD)]
    found = {r.doc_id: r for r in op.linked(docs(rows), with_groups=True).collect()}
    for doc_id, _, _, n_groups, _, _, _, digest in brute(rows, plain)[0]:
        row = found[doc_id]
        assert row.n_groups == n_groups == (row.groups.count(";") + 1 if digest else 0)
        assert hashlib.sha256(row.groups.encode()).hexdigest() == digest or not digest


def test_a_link_of_equal_bytes_in_a_larger_group_counts_once():
    # "aa" and "a" against "a" and "aa": the bytes of both ids are equal to each other's.
    cut = lambda a, b: tuple(x.tolist() for x in op.cut(np.array(a), np.array(b)))
    assert cut([2, 1], [1, 2]) == ([3], [0, 0, 1], [0, 1, 1])
    assert cut([1, 2, 3], [1, 3, 2]) == ([1, 6], [0, 1, 2, 2], [0, 1, 1, 2])
    assert op.identity_map([b"a", b"b", b"c"], [b"b", b"b", b"a"], [False, True, True]).tolist() == [2, 1, -1]
