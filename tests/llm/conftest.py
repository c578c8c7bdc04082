from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Columns that some operator uses by these names itself.
CLASHING = ["words", "text_key", "rep", "label", "spans", "key", "_doc_id", "at", "items"]


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) pairs, with clashing extra columns on demand."""

    def build(rows, clashing=False):
        extra = CLASHING if clashing else []
        schema = T.StructType([*DOCUMENTS, *[T.StructField(name, T.StringType()) for name in extra]])
        data = [(i, text, None, None, None if text is None else len(text), *["x"] * len(extra)) for i, text in rows]
        return spark.createDataFrame(data, schema)

    return build
