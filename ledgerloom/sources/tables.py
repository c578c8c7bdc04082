"""Parquet scans, and small frames from driver-side metadata."""

from __future__ import annotations

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


# Columns of the input tables that are used. Declaring them spares every query the
# job that would read file footers to find the schema.
INPUTS = {
    "lineitem": {
        "l_orderkey": T.LongType(),
        "l_partkey": T.LongType(),
        "l_suppkey": T.LongType(),
        "l_quantity": T.DoubleType(),
        "l_extendedprice": T.DoubleType(),
        "l_discount": T.DoubleType(),
        "l_shipdate": T.TimestampNTZType(),
    },
    "orders": {
        "o_orderkey": T.LongType(),
        "o_custkey": T.LongType(),
        "o_orderstatus": T.StringType(),
        "o_totalprice": T.DoubleType(),
        "o_orderdate": T.TimestampNTZType(),
        "o_orderpriority": T.StringType(),
    },
    "part": {"p_partkey": T.LongType(), "p_retailprice": T.DoubleType()},
    "supplier": {"s_suppkey": T.LongType(), "s_name": T.StringType(), "s_acctbal": T.DoubleType()},
    "events": {
        "event_id": T.LongType(),
        "ts": T.TimestampNTZType(),
        "user_id": T.LongType(),
        "event_type": T.StringType(),
        "value": T.DoubleType(),
    },
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of ``<name>.parquet`` files; lazy, columns pruned by use."""
    schema = T.StructType([T.StructField(column, kind) for column, kind in INPUTS[name].items()])
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def local_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A frame from a few rows of metadata, kept as a local relation in the plan."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)))


def metrics(observed: Observation, frame: DataFrame) -> dict:
    """What was observed while the frame was written; nothing if the plan was found to be empty,
    as then there is nothing to observe."""
    try:
        return observed.get
    except Py4JJavaError:
        if not frame.isEmpty():
            raise
        return {}
