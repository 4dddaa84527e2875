"""Queries that run first in a fresh interpreter and a fresh session, so nothing rests on what ran before."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": sys.argv[2]}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("rows", __spark_entry__.queries()[sys.argv[1]](spark, sys.argv[3]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["op1_ngram_join", "pipeline"])
def test_runs_first(name, tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", CODE, name, str(tmp_path), SF], cwd=root, capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0 and int(done.stdout.split("rows ")[1]) >= 150, done.stderr[-2000:]
