from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "ledgerloom.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
names = set(entry.queries())
assert "revenue_trend" in names and not any(name.startswith("op") and name[2].isdigit() for name in names)
assert "pipeline" not in names and set(entry.oracle_sql()) <= names
"""


def test_other_queries_work_without_the_training_data_package():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_trend_value(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.measures import trend_direction, trend_value

    row = spark.range(1).select(trend_value(F.lit(-3.26)).alias("v"), trend_direction(F.lit(-3.26)).alias("d")).first()
    assert (row.v, row.d) == (3.3, "down")


class _Session:
    """The settings of a session, without a cluster."""

    def __init__(self, master, **settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {"spark.sql.warehouse.dir": "file:/tmp/warehouse", **{k.replace("__", "."): v for k, v in settings.items()}}


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from ledgerloom.session import work_folder

    assert work_folder(_Session("local[4]"), "x").startswith("file:/tmp/warehouse/_work/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(_Session("yarn"), "x")
    assert work_folder(_Session("yarn", spark__checkpoint__dir="hdfs:///c/"), "x").startswith("hdfs:///c/x-")
    shared = _Session("yarn", **{"spark__sql__warehouse__dir": "s3a://bucket/w"})
    assert work_folder(shared, "x").startswith("s3a://bucket/w/_work/x-")
