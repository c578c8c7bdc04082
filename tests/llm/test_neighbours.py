from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours as op


def brute(rows, wanted=10):
    """rows: (vec_id, vector) that take part."""
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            distance = np.sqrt(((points - np.array(v, dtype=float)) ** 2).sum(axis=1))
            ranked = sorted((d, j) for d, j in zip(distance.tolist(), ids.tolist()) if j != i)
            out[i] = ranked[:wanted]
    return out


def test_recall_on_all_queries(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    expected = brute(rows)
    found = {}
    for r in op.report(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(expected)
    hits = 0
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    for query, ranked in found.items():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, 11))
        assert [(d, i) for _, i, d in ranked] == sorted((d, i) for _, i, d in ranked)
        for _, i, score in ranked:
            assert abs(score - np.sqrt(((vectors[i] - vectors[query]) ** 2).sum())) < 1e-12
        hits += len({i for _, i, _ in ranked} & {i for _, i in expected[query]})
    assert hits >= 0.9 * 10 * len(expected)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]),
        (600, [1.0, None]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]),
        (700, [1.0, 2.0, 3.0]), (4, []),
    ]
    table = spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<float>, cell string")
    found = {}
    for r in op.report(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    taking_part = [(0, [1, 0]), (100, [1, 0]), (1, [1, 0]), (2, [0, 1]), (3, [2, 0])]
    expected = {q: [(n + 1, i, d) for n, (d, i) in enumerate(ranked)] for q, ranked in brute(taking_part).items()}
    assert {q: sorted(ranked) for q, ranked in found.items()} == expected
    assert op.report(table.limit(0)).count() == 0
    assert op.report(table.where("vec_id = 2")).count() == 0


def test_a_very_common_vector(spark):
    random = np.random.default_rng(3)
    vectors = [random.normal(size=4).tolist() for _ in range(60)]
    rows = [(i, vectors[0] if i % 3 else vectors[i % 60]) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in op.report(table).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert {q: sorted(ranked) for q, ranked in found.items()} == brute(rows)


def test_walk_orders_cells_by_summed_distance():
    random = np.random.default_rng(5)
    index = op.Index(random.normal(size=(5, 2)), random.normal(size=(5, 2)), np.ones(25, np.int64))
    query = random.normal(size=4)
    walked = [cell for cell, _ in index.traverse(query)]
    sums = ((query[:2] - index.left) ** 2).sum(1)[:, None] + ((query[2:] - index.right) ** 2).sum(1)
    assert sorted(walked) == list(range(25))
    assert np.allclose(sums.ravel()[walked], np.sort(sums.ravel()))


def test_any_condition_chooses_queries(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    found = op.search(table, F.col("vec_id") == 4, wanted=2).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 3), (2, 5)]
