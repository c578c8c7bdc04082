"""What the trained operators share: held-out marks and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, others: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, others, label) of at most ``per_class`` labelled ids of each class, and the class sizes.

    Ids are drawn by their hash among all that are not held out; the bound is what makes
    the sample small enough to broadcast and to train on one machine. Rows whose label or
    id is null are left out.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    )
    # One row per id, so that repeated label rows cannot multiply the sample.
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {row["label"]: row["n"] for row in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = [
        usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    ids = drawn[0].union(drawn[1])
    texts = documents.select("doc_id", "text", *others).join(F.broadcast(ids), "doc_id")
    return texts, sizes
