"""The entry points in a session that the package did not build."""

import subprocess
import sys
from pathlib import Path

import pytest

from millrace import session

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
assert entry.entry(spark).limit(1).count() == 1
assert entry.queries()["unit_conversion"](spark, "/root/testdata/sf0.001").limit(1).count() == 1
print("BARE SESSION WORKS")
"""


def test_queries_run_in_a_bare_session():
    root = Path(__file__).resolve().parents[1]
    ran = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, capture_output=True, text=True, timeout=600)
    assert "BARE SESSION WORKS" in ran.stdout, ran.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="shared folder"):
        session.shared_dir(Session())


def test_scratch_tables_go_with_their_scope(spark):
    import os

    folder = os.path.join(session.shared_dir(spark), "millrace")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with session.scratch_scope(spark):
        kept = session.settle(spark.range(5), "numbers")
        assert kept.count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
