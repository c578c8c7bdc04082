"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (u, v): the smallest node it reaches.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours likewise, until nothing changes; that takes about log(longest path) rounds.
    A node's smallest neighbour is an aggregate that combines before its shuffle; the join
    that hands it to the neighbours is one that Spark can split at a hot node. Each round
    is a written table. Self-loops and nulls are dropped; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = stored(edges, "star")
    before = _checksum(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        after = _checksum(current)
        if after == before:
            break
        before = after
    tops = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        tops.select("node", F.col("node").alias("label"))
    )
