"""Merging an upload into the fact table, and keyed changes to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import KEY, MEASURES

# A batch may number up to 2**40 rows; the batch number fills the bits above.
BATCH_SHIFT = 40


def new_id(batch_no: int, seq: Column) -> Column:
    """Id of a row first seen as row ``seq`` of a batch: unique without a global counter.

    A row number or batch number that does not fit fails the job: its id would be that of
    another batch's row. A larger upload has to be split into several batches.
    """
    if not 0 <= batch_no < 1 << (63 - BATCH_SHIFT):
        raise ValueError(f"batch number {batch_no} does not fit an id")
    fits = (seq >= 0) & (seq < F.lit(1 << BATCH_SHIFT))
    failure = F.raise_error(F.lit(f"batch {batch_no} has more than 2**{BATCH_SHIFT} rows; split it")).cast("bigint")
    return F.when(fits, F.lit(batch_no << BATCH_SHIFT).cast("bigint") + seq).otherwise(failure)


def upsert(
    current: DataFrame, keys: DataFrame, batch_no: int, created_at: Column, created_by: Column
) -> DataFrame:
    """Current rows with the batch merged in: known keys take the new measures and
    keep id, owner and creation time; unknown keys are inserted.

    ``first_file`` says in which file a key that is new came first; for others it is null.
    Both sides hold each key once, so the join has no hot key.
    """
    old = current.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in ["id", "created_at", "created_by", *MEASURES]])
    known = F.col("_old_id").isNotNull()
    return old.join(keys, KEY, "full_outer").select(
        F.coalesce("_old_id", new_id(batch_no, F.col("first_seq"))).alias("id"),
        "date",
        *[F.coalesce(m, f"_old_{m}").alias(m) for m in MEASURES[:4]],
        "department",
        F.coalesce("sales_volume", "_old_sales_volume").alias("sales_volume"),
        F.when(known, F.col("_old_created_at")).otherwise(created_at).alias("created_at"),
        F.when(known, F.col("_old_created_by")).otherwise(created_by).alias("created_by"),
        F.when(~known, F.col("first_file")).alias("first_file"),
    )


def insert_if_absent(
    current: DataFrame, keys: DataFrame, batch_no: int, created_at: Column, created_by: Column
) -> DataFrame:
    """Current rows plus the batch's rows whose key is not there yet, in one pass over both.

    ``first_file`` says in which file a new key came first; for current rows it is null.
    """
    old = current.select(*KEY, F.struct(*[c for c in current.columns if c not in KEY]).alias("_old"))
    known = F.col("_old").isNotNull()
    fresh = {
        "id": new_id(batch_no, F.col("first_seq")),
        **{m: F.col(m) for m in MEASURES},
        "created_at": created_at,
        "created_by": created_by,
    }
    return old.join(keys, KEY, "full_outer").select(
        *[F.col(c) if c in KEY else F.when(known, F.col(f"_old.{c}")).otherwise(fresh[c]).alias(c) for c in current.columns],
        F.when(~known, F.col("first_file")).alias("first_file"),
    )


EDITABLE = ["date", "revenue", "cost", "expenses", "profit", "department", "sales_volume"]


def combine_changes(changes: DataFrame, columns: list[str]) -> DataFrame:
    """One change per id: for every field the last value that was supplied.

    ``changes`` has id, seq and nullable fields; NULL means "leave as it is".
    """
    return changes.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    )


def _changed(current: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    new = changes.select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    return current.join(new, "id", "left")


def colliding_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that would move a record onto a key that is taken.

    Taken means: some stored record has it now, or another change with a smaller
    id moves there. Only moved records (bounded by the change set) take part.
    """
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in KEY])
    targets = (
        current.select("id", *KEY)
        .join(new, "id")
        .select(
            "id",
            F.col("date").alias("_from_date"),
            F.col("department").alias("_from_department"),
            F.coalesce("_new_date", "date").alias("date"),
            F.coalesce("_new_department", "department").alias("department"),
        )
        .filter((F.col("date") != F.col("_from_date")) | (F.col("department") != F.col("_from_department")))
        .select("id", *KEY)
    )
    winners = targets.groupBy(*KEY).agg(F.min("id").alias("_winner"))
    taken = current.select(*KEY).join(targets.select(*KEY).distinct(), KEY, "left_semi").withColumn("_taken", F.lit(True))
    return (
        targets.join(winners, KEY)
        .join(taken, KEY, "left")
        .filter(F.col("_taken").isNotNull() | (F.col("id") != F.col("_winner")))
        .select("id", *KEY)
    )


def update_records(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Fact table with a change set applied; colliding changes are dropped whole."""
    combined = combine_changes(changes, EDITABLE)
    allowed = combined.join(colliding_changes(current, combined).select("id"), "id", "left_anti")
    return _changed(current, allowed, EDITABLE).select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in EDITABLE else F.col(c) for c in current.columns]
    )


USER_EDITABLE = ["name", "role", "is_active"]


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    combined = combine_changes(changes, USER_EDITABLE)
    return _changed(users, combined, USER_EDITABLE).select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in USER_EDITABLE else F.col(c) for c in users.columns]
    )


def delete_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def release_owner(children: DataFrame, removed: DataFrame, column: str) -> DataFrame:
    """Child rows of removed users stay, without an owner."""
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return children.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(column, kept).drop("_gone")
