"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook of K centroids, so that
every vector lies in one of K x K cells. A query walks pairs of centroids by the sum of its
two distances, with a heap, until the cells seen hold enough rows; all their entries are
then reranked by the exact distance.

1. Equal vectors become one entry with the smallest ids that a result can need, so that a
   vector that fills a third of the table stays one row.
2. The codebooks are fitted by k-means on at most ``SAMPLE`` entries; every entry is indexed.
3. How many rows to walk over is measured, not set: for at most ``PROBES`` queries the
   exact neighbours are found by a full scan, and the walk is made long enough to reach
   ``RECALL`` of them.
4. Cells are dealt to parts of the table, large cells to several; a query goes to the
   parts its cells are in, with the list of these cells. Parts and blocks of queries have
   bounded sizes. Each yields at most the wanted number of rows per query.

Defined cases: vectors that are null, zero or have null or non-finite components take no
part, as query or candidate, nor do rows without an id or of another length than most (the
longer of equally frequent ones); rows with the query's own id are no candidates; other
repeated rows are one; fewer candidates than wanted are all returned; ties go to the
smaller id; an empty table gives no rows. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

WANTED = 10
SAMPLE = 20_000
PROBES = 64
RECALL = 0.95
ROWS_PER_CELL = 16
MOST_CENTROIDS = 1024  # a half; the counts of K x K cells are kept on the driver
PART_ROWS, QUERY_BLOCK = 4096, 2048


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): rows that take part, as doubles, repeated ones once."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    usable = embeddings.select(F.col("vec_id").cast("long"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = usable.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return usable.where(F.size("vector") == (most["size"] if most else 0))


def entries(vectors: DataFrame, wanted: int) -> DataFrame:
    """(vector, ids, n): each distinct vector with its smallest ids, one more than wanted."""
    # A vector's rank filter runs in every task before the shuffle.
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= wanted + 1)
    ids = F.sort_array(F.collect_set("vec_id"))
    return first.groupBy("vector").agg(ids.alias("ids")).withColumn("n", F.size("ids"))


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left * left).sum(axis=1)[:, None] - 2 * (left @ right.T) + (right * right).sum(axis=1)
    return np.maximum(out, 0)


def _k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centers = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squares(points, centers).argmin(axis=1)
        count = np.bincount(nearest, minlength=k)
        total = np.stack([np.bincount(nearest, column, minlength=k) for column in points.T], axis=1)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


@dataclass
class Index:
    """Codebooks, rows per cell, and how many rows a walk takes in."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    walk: int = 0

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a = _squares(vectors[:, : self.half], self.left).argmin(axis=1)
        b = _squares(vectors[:, self.half :], self.right).argmin(axis=1)
        return a * len(self.right) + b

    def traverse(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """(cell, rows seen with it): cells by the sum of the two centroid distances."""
        a = _squares(vector[None, : self.half], self.left)[0]
        b = _squares(vector[None, self.half :], self.right)[0]
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[rows].tolist(), b[columns].tolist()
        rows, columns = rows.tolist(), columns.tolist()
        width, seen = len(columns), 0
        # The heap holds, for every opened row of the sorted grid, its next pair.
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * width + columns[j]
            if self.counts[cell]:
                seen += int(self.counts[cell])
                yield cell, seen
            if j + 1 < width:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def walked(self, vector: np.ndarray) -> list[int]:
        out = []
        for cell, seen in self.traverse(vector):
            out.append(cell)
            if seen >= self.walk:
                break
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _with_cells(table: DataFrame, index: Index) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pa.array(index.cells(_matrix(batch.column("vector"))), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["vector", "ids", "n", "cell"])

    schema = "vector array<double>, ids array<bigint>, n int, cell int"
    return table.select("vector", "ids", "n").mapInArrow(assign, schema)


def nearest(
    queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: list[np.ndarray], allowed: np.ndarray | None, wanted: int
) -> Iterator[tuple[int, int, float, int]]:
    """(query id, id, distance, point) of the wanted nearest allowed points of each query."""
    if not len(points):
        return
    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        rough = _squares(queries[part], points)
        if allowed is not None:
            rough[~allowed[part]] = np.inf
        last = min(wanted, len(points) - 1)  # one more than wanted: one may be the query itself
        bound = np.partition(rough, last, axis=1)[:, last]
        for q in range(len(rough)):
            # Slack for rounding; the exact distances decide.
            near = np.flatnonzero((rough[q] <= bound[q] + 1e-9 * (1 + bound[q])) & np.isfinite(rough[q]))
            gap = queries[at + q] - points[near]
            exact = np.sqrt((gap * gap).sum(axis=1))
            own = query_ids[at + q]
            found = [(d, i, p) for d, p in zip(exact.tolist(), near.tolist()) for i in ids[p].tolist() if i != own]
            for d, i, p in heapq.nsmallest(wanted, found):
                yield int(own), i, d, p


def _probe(table: DataFrame, probes: pa.Table, wanted: int) -> DataFrame:
    """(query_id, vec_id, score, cell): exact neighbours of a few queries, by a full scan."""
    queries, names = _matrix(probes.column("vector").combine_chunks()), probes.column("vec_id").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(x) for x in batch.column("ids").to_pylist()]
            points, cells = _matrix(batch.column("vector")), batch.column("cell").to_numpy()
            rows = [(q, i, d, int(cells[p])) for q, i, d, p in nearest(queries, names, points, ids, None, wanted)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column) for column in zip(*rows)], names=["query_id", "vec_id", "score", "cell"]
                )

    return table.mapInArrow(scan, "query_id long, vec_id long, score double, cell long")


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def build(table: DataFrame, queries: DataFrame, wanted: int) -> tuple[DataFrame, Index]:
    """Entries with their cells, and the index with a measured walk."""
    n = table.count()
    k = max(1, min(MOST_CENTROIDS, int((n / ROWS_PER_CELL) ** 0.5)))
    drawn = table.select("vector", F.get("ids", F.lit(0)).alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = _matrix(drawn.select("vector").toArrow().column("vector").combine_chunks())
    half = sample.shape[1] // 2
    k = min(k, len(sample))
    index = Index(_k_means(sample[:, :half], k), _k_means(sample[:, half:], k), np.zeros(k * k, np.int64))
    celled = stored(_with_cells(table, index), "cells")
    for row in celled.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        index.counts[row["cell"]] = row["n"]

    probes = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("vec_id", "vector").toArrow()
    exact = _ranked(_probe(celled, probes, wanted), wanted).select("query_id", "cell").collect()
    cells: dict[int, list[int]] = {}
    for row in exact:
        cells.setdefault(row["query_id"], []).append(row["cell"])
    needed = []
    for name, vector in zip(probes.column("vec_id").to_pylist(), _matrix(probes.column("vector").combine_chunks())):
        missing = list(cells.get(name, []))
        for cell, seen in index.traverse(vector):
            if not missing:
                break
            needed += [seen] * missing.count(cell)
            missing = [other for other in missing if other != cell]
    reach = int(np.quantile(needed, RECALL)) if needed else 0
    index.walk = max(reach, 2 * wanted + 2)
    return celled, index


def search(embeddings: DataFrame, is_query, wanted: int = WANTED) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every query row.

    ``is_query`` is a condition on ``vec_id``; ``score`` the Euclidean distance.
    """
    spark = embeddings.sparkSession
    vectors = stored(valid(embeddings), "vectors")
    result = "query_id long, vec_id long, score double"
    table = stored(entries(vectors, wanted), "entries")
    queries = vectors.where(is_query).distinct()
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], f"{result}, rank int").select("query_id", "rank", "vec_id", "score")
    celled, index = build(table, queries, wanted)

    parts = max(1, int(index.counts.sum()) // PART_ROWS)
    blocks = -(-n_queries // QUERY_BLOCK)
    splits = np.maximum(1, -(-index.counts // PART_ROWS))

    def part_of(cell: np.ndarray, split: np.ndarray) -> np.ndarray:
        mixed = (cell.astype(np.uint64) * np.uint64(1_000_003) + split.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)

    def deal_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            first = np.array([ids[0] for ids in batch.column("ids").to_pylist()], dtype=np.int64)
            part = part_of(cell, first % splits[cell]) if len(cell) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), batch.column("cell"), batch.column("vector"), batch.column("ids")],
                names=["part", "cell", "vector", "ids"],
            )

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, vector in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("vector"))):
                cells = np.array(index.walked(vector), dtype=np.int32)
                cell = np.repeat(cells, splits[cells])
                split = np.concatenate([np.arange(n) for n in splits[cells]])
                part = part_of(cell, split)
                order = np.argsort(part, kind="stable")
                found, start = np.unique(part[order], return_index=True)
                lists = [np.unique(x) for x in np.split(cell[order], start[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.int32()),
                        pa.array([name] * len(found), pa.int64()),
                        pa.array([vector] * len(found), pa.list_(pa.float64())),
                        pa.array(lists, pa.list_(pa.int32())),
                    ],
                    names=["part", "vec_id", "vector", "cells"],
                )

    def rerank(queries: pa.Table, points: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and points.num_rows:
            cell = points.column("cell").to_numpy()
            distinct, column = np.unique(cell, return_inverse=True)
            walks = np.zeros((queries.num_rows, len(distinct)), dtype=bool)
            for i, cells in enumerate(queries.column("cells").to_pylist()):
                walks[i, np.flatnonzero(np.isin(distinct, cells, assume_unique=True))] = True
            rows = [
                (q, i, d)
                for at in range(0, queries.num_rows, 256)
                for q, i, d, _ in nearest(
                    _matrix(queries.column("vector").slice(at, 256).combine_chunks()),
                    queries.column("vec_id").slice(at, 256).to_numpy(),
                    _matrix(points.column("vector").combine_chunks()),
                    [np.asarray(x) for x in points.column("ids").to_pylist()],
                    walks[at : at + 256][:, column],
                    wanted,
                )
            ]
        return pa.table(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            names=["query_id", "vec_id", "score"],
        )

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt_queries = queries.mapInArrow(
        deal_queries, "part int, vec_id long, vector array<double>, cells array<int>"
    ).withColumn("block", block)
    dealt_points = celled.mapInArrow(
        deal_entries, "part int, cell int, vector array<double>, ids array<bigint>"
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["part", "block"]
    near = dealt_queries.groupBy(*keys).cogroup(dealt_points.groupBy(*keys)).applyInArrow(rerank, result)
    return _ranked(near, wanted).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The query: rows whose id is divisible by 100, against all."""
    return search(embeddings, F.col("vec_id") % 100 == 0)
