from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import queries
from ledgerloom.llm import sharding as op


def expected(rows, shards=op.SHARDS):
    """(doc_id, size, crc, shard, slot) in the order of the key, size and checksum."""
    data = [(i, (text or "").encode()) for i, text in rows]
    sized = sorted(((i is not None, i or 0), len(b) + 1, zlib.crc32(b), i) for i, b in data)
    total, at, slots, out = sum(row[1] for row in sized), 0, Counter(), []
    for _, size, checksum, doc_id in sized:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((doc_id, size, checksum, shard, slots[shard]))
        at, slots[shard] = at + size, slots[shard] + 1
    return out


def found(frame):
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in frame.collect()]


def near_equal(rows, shards=op.SHARDS):
    size = Counter()
    for row in rows:
        size[row[3]] += row[1]
    target, largest = sum(size.values()) / shards, max(row[1] for row in rows)
    return all(abs(size[shard] - target) <= largest for shard in range(shards))


def test_whole_table_against_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    frame = queries.op13_sharding(spark, folder)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    own = found(frame)
    assert sorted(own) == sorted(expected(rows)) and near_equal(own)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = connection.sql(queries.ORACLE_SQL["op13_sharding"]).df()
    assert set(sql.columns) == set(frame.columns)
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, sql[columns].values.tolist())) == sorted(own)


def test_edges(docs):
    long = "é\U0001f600" * 40_000
    rows = [(None, None), (None, "no id"), (1, None), (1, ""), (2, "same"), (2, "same"), (2, "other"), (3, long)]
    rows += [(4, "a copy of a text")] * 700 + [(i, "x" * (i % 37)) for i in range(5, 600)]
    frame = op.report(docs(rows, clashing=True))
    assert frame.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(found(frame), key=str) == sorted(expected(rows), key=str)
    assert {(r.law, r.grown_shard) for r in frame.collect()} == {("bytes", None)}
    assert op.report(docs([])).count() == 0
    assert found(op.report(docs([(7, None)]))) == [(7, 1, 0, 4, 0)]


def test_a_hot_key_is_spread(docs):
    rows = [(1, f"text {i:05d}") for i in range(3000)] + [(i, "short") for i in range(2, 1500)]
    own = found(op.report(docs(rows)))
    assert sorted(own) == sorted(expected(rows)) and near_equal(own)


def test_plan_is_native(docs):
    plan = op.report(docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("shards", [1, 3])
def test_written_shards_hold_all_rows_in_order(spark, docs, tmp_path, shards):
    rows = [(i % 90, f"text {i}" * (i % 5)) for i in range(400)] + [(None, None)]
    table = docs(rows, clashing=True)
    folder = f"{tmp_path}/shards"
    op.write(table, folder, shards, column="part")
    back = spark.read.parquet(folder)
    assert back.drop("part").exceptAll(table).isEmpty() and back.count() == len(rows)
    keys = [sorted(r.doc_id or -1 for r in back.where(f"part = {shard}").collect()) for shard in range(shards)]
    assert all(a[-1] <= b[0] for a, b in zip(keys, keys[1:]))
    with pytest.raises(ValueError):
        op.write(table, f"{folder}-2", shards, column="label")
