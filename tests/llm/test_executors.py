"""Executors need no copy of the package: queries run where only the driver's own process can import it."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")
PROGRAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sys.path.insert(0, sys.argv[1])  # workers take their path from the environment, not from here
import __spark_entry__
for name in sys.argv[4:]:
    print(name, len(__spark_entry__.queries()[name](spark, sys.argv[3]).collect()))
"""


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries_without_the_package_on_executors(tmp_path):
    names = ["op1_url_filter", "op5_language_id", "op8_media", "op6_packing"]
    out = subprocess.run([sys.executable, "-c", PROGRAM, str(ROOT), str(tmp_path / "shared"), str(DATA), *names], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert [line.split()[0] for line in out.stdout.splitlines()] == names, out.stderr[-2000:]
