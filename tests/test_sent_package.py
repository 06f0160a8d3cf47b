"""Queries that run candidates, in a session to which the package was sent as an archive, against their SQL."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
PROGRAM = """
import sys
import duckdb
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[3])
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
entry._send(spark)
name, data = sys.argv[1:3]
out = entry.queries()[name](spark, data)
got = sorted(map(repr, map(tuple, out.collect())))
con = duckdb.connect()
for t in ("documents", "benchmark"):
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
print("SAME" if got == sorted(map(repr, want)) else f"DIFFERENT {got[:3]}", len(want))
"""


@pytest.mark.parametrize("name", ["replaced_run", "stream_run", "resumed_batch", "run_bundle"])
def test_equal_to_sql(name, tmp_path):
    said = subprocess.run([sys.executable, "-c", PROGRAM, name, DATA, ROOT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "SAME" in said.stdout.split(), (said.stdout, said.stderr[-2000:])
