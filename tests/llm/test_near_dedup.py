from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import near_dedup as op
from ledgerloom.llm.components import components
from ledgerloom.llm.shingling import shingle_set, word_hashes


def shingles(text, n):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(rows, n, percent):
    sets = [shingles(text, n) for _, text in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, component is None or doc_id == component))
    return out


def corpus():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdef") for _ in range(5))
    rows, number = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two")], 10
    for _ in range(12):
        base = [word() for _ in range(random.choice([8, 40, 120]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 4])):
                copy[random.randrange(len(copy))] = word()
            rows.append((number, " ".join(copy)))
            number += 1
        # A chain: each link is near, its ends are not.
        for _ in range(6):
            base[random.randrange(len(base))] = word()
            rows.append((number, " ".join(base)))
            number += 1
    rows += [(None, rows[-1][1]), (rows[-1][0], rows[-1][1]), (None, "nothing like it at all")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(docs, monkeypatch, words, percent):
    monkeypatch.setattr(op, "SIGNATURE_BLOCK", 4)
    monkeypatch.setattr(op, "SET_BLOCK", 3)
    rows = corpus()
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.groups(docs(rows, clashing=True), words, percent).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, words, percent), key=str)


def test_one_row_of_each_group_stays(docs):
    rows = [(3, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (5, None), (5, None), (None, "x y"), (9, "z")]
    table = docs(rows, clashing=True)
    kept = op.drop_duplicates(table)
    assert kept.columns == table.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [2, 5, 5, 9, None]
    assert op.drop_duplicates(docs([])).count() == 0


def shared_ids():
    """One id on unrelated texts, near copies of each of them, and near copies without ids."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdef") for _ in range(5))
    bases = [[word() for _ in range(60)] for _ in range(5)]
    near = lambda i: " ".join([*bases[i][:-1], word()])
    rows = [(1, " ".join(bases[0])), (1, " ".join(bases[1])), (1, " ".join(bases[2]))]
    rows += [(7, near(0)), (8, near(1)), (9, near(2)), (None, near(1))]
    rows += [(None, near(3)), (None, near(3)), (None, " ".join(bases[3]))]
    return [*rows, (20, near(4)), (None, " ".join(bases[4])), (21, near(4))]


def test_rows_that_share_an_id_are_linked_by_their_texts(docs):
    rows = shared_ids()
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.groups(docs(rows)).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, 5, 80), key=str)
    kept = [(r.doc_id, r.text) for r in op.drop_duplicates(docs(rows)).collect()]
    assert sorted(text for i, text in kept if i == 1) == sorted(text for i, text in rows if i == 1)
    unnamed = [text for i, text in kept if i is None]
    assert len(unnamed) == 1 and unnamed[0] in {text for _, text in rows[7:10]}
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 1, 20]


def test_intersections_by_slabs():
    random_ = np.random.default_rng(1)
    sets = [np.unique(random_.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    common = op.common_counts(sets, width=7)
    assert (common - np.diag(np.diag(common)) == np.array(expected) - np.diag(np.diag(expected))).all()


def test_shingles_are_sets_of_words():
    assert len(word_hashes(b"a\x0bB  c\x1cd")) == 3
    assert (word_hashes(b"Abc x" + b"y" * 300) == word_hashes(b"aBC x" + b"Y" * 300)).all()
    assert len(shingle_set("a b a b a b".encode(), 3)) == 2
    assert (shingle_set(b"a b", 3) != shingle_set(b"a b a", 3)).all()


def test_components_of_random_graphs(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(random.randrange(90), random.randrange(90)) for _ in range(60)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {node: node for edge in edges for node in edge}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    linked = {node for u, v in edges if u != v for node in (u, v)}
    assert found == {node: label[node] for node in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_members_of_one_component_are_not_dealt_against_each_other(spark):
    """A component of 5,000 members, another of 1,500 and ten strays in one bucket."""
    label = "CASE WHEN id < 5000 THEN 0L WHEN id < 6500 THEN 5000L ELSE id END AS label"
    members = spark.range(6510).selectExpr("7L AS bucket", "id AS rep", label, f"1.0D / {op.SIGNATURE_BLOCK} AS weight")
    dealt = op._blocks(members, spark.range(6510).selectExpr("id AS rep", "id AS payload"))
    rows = dealt.select("pair", "rep", "label").toPandas()
    # Each block meets the other component's blocks (5 and 2) and the one of the strays.
    assert len(rows) <= 5000 * (2 + 1) + 1500 * (5 + 1) + 10 * (5 + 2 + 1)
    met = set()
    for _, group in rows.groupby("pair"):
        labels = set(group.label)
        assert len(labels) > 1 and len(group) <= 3 * op.SIGNATURE_BLOCK
        if 0 in labels and 5000 in labels:
            met.update((a, b) for a in group.rep[group.label == 0][::97] for b in group.rep[group.label == 5000][::89])
        strays = group.rep[group.rep >= 6500]
        met.update((a, b) for a in group.rep for b in strays if a != b)
    assert all((a, b) in met for a in range(6510) for b in range(6500, 6510) if a != b)
