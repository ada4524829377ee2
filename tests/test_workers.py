"""The package reaches Python workers from any working directory."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
CODE = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["model_scores"](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, timeout=200,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stdout and "rows 0" not in done.stdout
