"""Intermediate tables: in the folder the cluster names, and gone with the session."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import os, sys
from pyspark.sql import SparkSession
from basketlab.sources.scratch import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
assert one.count() + two.count() == 12
print("tables", sum(f == "_SUCCESS" for _, _, files in os.walk(sys.argv[1]) for f in files))
spark.stop()
"""


def test_scratch_tables_go_with_their_session(tmp_path):
    kept = tmp_path / "kept"
    kept.write_text("of others")
    run = subprocess.run([sys.executable, "-c", JOB, str(tmp_path)], cwd=REPO, capture_output=True, text=True, timeout=200)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "tables 2" in run.stdout
    # Spark makes an empty folder of its own there
    assert [os.path.join(d, f) for d, _, files in os.walk(tmp_path) for f in files] == [str(kept)]
