"""The fact table as partitioned parquet that batches replace piece by piece.

    data/attempt=A/ym=YYYY-MM/bucket=B/   rows an attempt wrote; never changed afterwards
    cells/attempt=A/ym=YYYY-MM/bucket=B/  the same condensed per month and department
    id_index/attempt=A/                   where an id may be: smallest, largest, bits of its hashes
    users/attempt=A/                      all users, as an attempt left them
    current/attempt=A/                    which attempt holds each (ym, bucket) after this one
    upload_history, rejects, alerts, alert_marks, released   one sub-folder per attempt
    commits/version=V/                    one row: the attempt that became version V

Every run of a job is an attempt under a random name. It reads and rewrites only the pieces it
touches, into folders of that name. Writing its commit last makes all of it current at
once; readers join logs with the commits, so what a dead attempt left is never seen,
whatever is committed after it. A piece is a month's departments of one bucket, so a month that
holds a third of all rows is still many pieces, and a department has at most 31 rows
in any of them. Metrics and alert rules read the cells, so after a small upload only the touched
months are read in full. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.measures import month_label
from ledgerloom.operators.alerts import mark_read
from ledgerloom.operators.filters import Scope, parse_day
from ledgerloom.operators.rollup import cells
from ledgerloom.schema import ALERTS, BUSINESS_DATA, MEASURES, UPLOAD_HISTORY, USERS
from ledgerloom.sources.tables import local_frame, metrics

PIECES = T.StructType(
    [
        T.StructField("ym", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("held_by", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)
COMMIT = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("users", T.StringType()),
        T.StructField("epochs", T.MapType(T.StringType(), T.LongType())),
    ]
)
CELLS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("department", T.StringType()),
        *[T.StructField(m, T.DecimalType(25, 2)) for m in MEASURES[:4]],
        T.StructField("sales_volume", T.LongType()),
        T.StructField("records", T.LongType()),
        T.StructField("margin_sum", T.DoubleType()),
        T.StructField("margin_count", T.LongType()),
        T.StructField("ym", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
SETTINGS = T.StructType([T.StructField("buckets", T.IntegerType())])
STORED = T.StructType([*BUSINESS_DATA, T.StructField("ym", T.StringType()), T.StructField("bucket", T.IntegerType())])
REJECTS = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
IDS = T.StructType([T.StructField("id", T.LongType())])
ID_INDEX = T.StructType(
    [
        T.StructField("ym", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("bits", T.BinaryType()),
    ]
)
# Each id sets two bits of up to 2**21, in pages of 2**15; only pages with bits are kept. A piece
# of 100,000 ids then answers for an id it lacks in about one case of a hundred.
PAGE_BITS, PAGES = 2**15, 64

# Up to this many ids are looked up in the index; more are met with every id of the table, since
# nearly every piece holds one of them anyway.
LOOKED_UP = 1_000


class Piece(NamedTuple):
    ym: str
    bucket: int
    held_by: int
    attempt: str


class State(NamedTuple):
    """What one commit made current. ``users`` and a piece's ``attempt`` say who wrote it."""

    version: int
    batch_no: int
    users: str | None
    epochs: dict[str, int]
    pieces: list[Piece]

    def without(self, touched: set[tuple[str, int]]) -> list[Piece]:
        return [p for p in self.pieces if (p.ym, p.bucket) not in touched]

    def only(self, touched: set[tuple[str, int]]) -> list[Piece]:
        return [p for p in self.pieces if (p.ym, p.bucket) in touched]


class Ledger:
    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._version = 0  # known to be committed

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 16) -> Ledger:
        """An empty table. ``buckets`` is fixed for its life."""
        ledger = cls(spark, root, buckets)
        local_frame(spark, [{"buckets": buckets}], SETTINGS).coalesce(1).write.parquet(f"{ledger.root}/settings")
        Attempt(ledger, State(-1, 0, None, {}, []), 0).publish([])
        return ledger

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Ledger:
        buckets = spark.read.schema(SETTINGS).parquet(f"{root.rstrip('/')}/settings").first()["buckets"]
        return cls(spark, root, buckets)

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    # -- commits --------------------------------------------------------------

    def _commit(self, version: int) -> Row | None:
        """The commit with that number; None if there is none, or one that was cut short."""
        path = f"{self.root}/commits/version={version}"
        return self.spark.read.schema(COMMIT).parquet(path).first() if self._exists(path) else None

    def _last_version(self) -> int:
        """Versions have no gaps, so the last one is found by steps that double and then halve."""
        known, step = self._version, 1
        while self._commit(known + step):
            known, step = known + step, 2 * step
        while step > 1:
            step //= 2
            if self._commit(known + step):
                known += step
        self._version = known
        return known

    def last_batch(self) -> int:
        """Number of the last committed batch."""
        return self._commit(self._last_version())["batch"]

    def state(self) -> State:
        """The last commit and its pieces: at most months x buckets names."""
        version = self._last_version()
        commit = self._commit(version)
        listed = self.spark.read.schema(PIECES).parquet(f"{self.root}/current/attempt={commit['attempt']}")
        pieces = [Piece(*row) for row in listed.filter(F.col("bucket") >= 0).collect()]
        return State(version, commit["batch"], commit["users"], commit["epochs"] or {}, pieces)

    def begin(self, batch_no: int | None = None) -> Attempt | None:
        """A new attempt at a batch, by default the next one; None if that number was taken."""
        state = self.state()
        if batch_no is None:
            batch_no = state.batch_no + 1
        return Attempt(self, state, batch_no) if batch_no > state.batch_no else None

    def has_epoch(self, stream: str, epoch: int) -> bool:
        """Whether that micro-batch of that stream, or a later one, was committed."""
        return self.state().epochs.get(stream, -1) >= epoch

    # -- rows -----------------------------------------------------------------

    def bucket_of(self, department: Column) -> Column:
        return F.pmod(F.xxhash64(department), F.lit(self.buckets)).cast("int")

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("ym", month_label(F.col("date"))).withColumn("bucket", self.bucket_of(F.col("department")))

    def _pieces_of(self, name: str, schema: T.StructType, pieces: list[Piece] | None) -> DataFrame:
        chosen = self.state().pieces if pieces is None else pieces
        if not chosen:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        paths = [f"{base}/attempt={p.attempt}/ym={p.ym}/bucket={p.bucket}" for p in chosen]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("attempt")

    def read(self, pieces: list[Piece] | None = None) -> DataFrame:
        """Rows of the given (default: all current) pieces, with ym and bucket."""
        return self._pieces_of("data", STORED, pieces)

    def cells(self, pieces: list[Piece] | None = None) -> DataFrame:
        """Monthly cells of the given (default: all current) pieces."""
        return self._pieces_of("cells", CELLS, pieces)

    def scoped(self, scope: Scope = Scope()) -> DataFrame:
        """Rows in scope. The dates and the department also select pieces, so files
        of other months and buckets are not opened."""
        df = self.read()
        start, end = parse_day(scope.start), parse_day(scope.end)
        if start is not None:
            df = df.filter(F.col("ym") >= start.strftime("%Y-%m"))
        if end is not None:
            df = df.filter(F.col("ym") <= end.strftime("%Y-%m"))
        if scope.department and scope.department != "all":
            df = df.filter(F.col("bucket") == self.bucket_of(F.lit(scope.department)))
        return scope.apply(df)

    def touched(self, placed: DataFrame) -> set[tuple[str, int]]:
        """Distinct (ym, bucket) of some rows: names only, at most months x buckets."""
        return {(r.ym, r.bucket) for r in placed.select("ym", "bucket").distinct().collect()}

    def may_hold(self, ids: DataFrame, state: State | None = None) -> list[Piece]:
        """The pieces that can hold one of the ids; others are not opened.

        A piece answers by the smallest and largest id of a page and by two bits of an id's
        hashes. More than ``LOOKED_UP`` ids may be anywhere, so all pieces are returned.
        """
        pieces = (state or self.state()).pieces
        wanted = [row["id"] for row in ids.select("id").distinct().limit(LOOKED_UP + 1).collect()]
        if len(wanted) > LOOKED_UP or not pieces:
            return pieces
        probes = local_frame(self.spark, [{"id": i} for i in wanted], IDS).select("id", F.explode(_bits("id")).alias("bit"))
        probes = probes.select("id", *_paged("bit"))
        paths = [f"{self.root}/id_index/attempt={name}" for name in sorted({p.attempt for p in pieces})]
        index = self.spark.read.schema(_with_attempt(ID_INDEX)).option("basePath", f"{self.root}/id_index").parquet(*paths)
        current = local_frame(self.spark, [p._asdict() for p in pieces], PIECES).select("ym", "bucket", "attempt")
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("position", 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, F.col("position").bitwiseAND(7).cast("int")) == 1
        found = index.join(probes, "page").where(F.col("id").between(F.col("low"), F.col("high")) & hit)
        both = found.groupBy("ym", "bucket", "attempt", "id").agg(F.count("*").alias("n"))
        needed = probes.groupBy("id").agg(F.count("*").alias("needed"))
        holding = both.join(needed, "id").where("n = needed").join(current, ["ym", "bucket", "attempt"])
        chosen = self.touched(holding)
        return [p for p in pieces if (p.ym, p.bucket) in chosen]

    # -- logs -----------------------------------------------------------------

    def commits(self, through: int | None = None) -> DataFrame:
        """(version, attempt) of all commits, or those up to a version."""
        schema = T.StructType([*COMMIT, T.StructField("version", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/commits").select("version", "attempt")
        return rows if through is None else rows.filter(F.col("version") <= through)

    def logged(self, name: str, schema: T.StructType, through: int | None = None, versions: bool = False) -> DataFrame:
        """Log rows of committed attempts, on demand with the ``version`` that each came with."""
        path = f"{self.root}/{name}"
        if self._exists(path):
            rows = self.spark.read.schema(_with_attempt(schema)).parquet(path)
        else:
            rows = self.spark.createDataFrame([], _with_attempt(schema))
        rows = rows.join(self.commits(through), "attempt").drop("attempt")
        return rows if versions else rows.drop("version")

    def upload_history(self) -> DataFrame:
        """All logged files; the uploader of a file is null once that user was removed."""
        rows = self.logged("upload_history", UPLOAD_HISTORY, versions=True)
        gone = self.logged("released", IDS, versions=True).groupBy("id").agg(F.max("version").alias("_gone"))
        released = F.col("_gone") > F.col("version")
        kept = F.when(~F.coalesce(released, F.lit(False)), F.col("uploaded_by"))
        joined = rows.join(gone.withColumnRenamed("id", "_id"), F.col("uploaded_by") == F.col("_id"), "left")
        return joined.withColumn("uploaded_by", kept).drop("_id", "_gone", "version")

    def rejects(self) -> DataFrame:
        return self.logged("rejects", REJECTS)

    def alerts(self, through: int | None = None) -> DataFrame:
        """Alerts with the read marks applied."""
        return mark_read(self.logged("alerts", ALERTS, through), self.logged("alert_marks", IDS, through))

    def users(self, state: State | None = None) -> DataFrame:
        """The users as of a state; none until some were stored."""
        holder = (state or self.state()).users
        if holder is None:
            return self.spark.createDataFrame([], USERS)
        return self.spark.read.schema(USERS).parquet(f"{self.root}/users/attempt={holder}")


class Attempt:
    """One run of a job. Nothing it writes is seen before ``publish``."""

    def __init__(self, ledger: Ledger, state: State, batch_no: int):
        self.ledger, self.state, self.batch_no = ledger, state, batch_no
        self.name = uuid.uuid4().hex
        self.users, self.epochs = state.users, dict(state.epochs)

    def _folder(self, name: str) -> str:
        return f"{self.ledger.root}/{name}/attempt={self.name}"

    def write_version(self, df: DataFrame) -> list[Piece]:
        """Writes rows, their cells and their id index; lists the pieces, observed while rows are written."""
        ledger = self.ledger
        rows = ledger.placed(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BUSINESS_DATA]))
        written = Observation()
        self._write(rows.observe(written, F.collect_set(F.struct("ym", "bucket")).alias("pieces")), "data", "department", "date")
        found = metrics(written, rows).get("pieces", [])
        pieces = sorted(Piece(p["ym"], p["bucket"], self.batch_no, self.name) for p in found)
        if pieces:
            stored = ledger.read(pieces)
            condensed = cells(stored, "ym", "bucket")
            self._write(condensed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CELLS]), "cells", "department")
            id_index(stored).write.parquet(self._folder("id_index"))
        return pieces

    def _write(self, df: DataFrame, name: str, *order: str) -> None:
        """The rebalance hint lets adaptive execution split big pieces over several
        tasks and files and merge small ones."""
        (
            df.hint("rebalance", F.col("ym"), F.col("bucket"))
            .sortWithinPartitions("ym", "bucket", *order)
            .write.partitionBy("ym", "bucket")
            .parquet(self._folder(name))
        )

    def write_users(self, users: DataFrame) -> None:
        """All users; they take the place of the former ones with the commit."""
        users.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in USERS]).write.parquet(self._folder("users"))
        self.users = self.name

    def log(self, name: str, df: DataFrame) -> DataFrame:
        """Writes log rows, and returns them as they were written."""
        df.write.parquet(self._folder(name))
        return self.ledger.spark.read.schema(df.schema).parquet(self._folder(name))

    def publish(self, pieces: Iterable[Piece]) -> None:
        """Commits: the list of current pieces first, then the one row that makes it all current."""
        spark, version = self.ledger.spark, self.state.version + 1
        rows = [p._asdict() for p in pieces] or [Piece("", -1, 0, "")._asdict()]
        local_frame(spark, rows, PIECES).coalesce(1).write.parquet(self._folder("current"))
        commit = {"batch": self.batch_no, "attempt": self.name, "users": self.users, "epochs": list(self.epochs.items())}
        # Overwriting replaces what a commit that was cut short left.
        one = local_frame(spark, [commit], COMMIT).coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.ledger.root}/commits/version={version}")


def _bits(column: str) -> Column:
    """The two bits of an id."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(PAGES * PAGE_BITS)) for seed in (1, 2)]))


def _paged(bit: str) -> list[Column]:
    page = F.shiftright(bit, 15).cast("int").alias("page")
    return [page, F.col(bit).bitwiseAND(PAGE_BITS - 1).cast("int").alias("position")]


def id_index(rows: DataFrame) -> DataFrame:
    """One row per (ym, bucket, page): smallest and largest id with a bit there, and the bits."""
    bits = rows.select("ym", "bucket", "id", F.explode(_bits("id")).alias("bit")).select("ym", "bucket", "id", *_paged("bit"))
    # Positions count from 1 in Spark's bitmaps, and are made from that number.
    return bits.groupBy("ym", "bucket", "page").agg(
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("position") + 1)).alias("bits"),
    )


def _with_attempt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("attempt", T.StringType())])
