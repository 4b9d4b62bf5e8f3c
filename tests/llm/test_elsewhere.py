"""Executors that don't have the package: a driver started elsewhere, which alone knows where it is."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__
from pagemill.session import local_session
spark = local_session(4, spark_sql_shuffle_partitions="2")
spark.sparkContext.setLogLevel("ERROR")
queries = __spark_entry__.queries()
for name in sorted(n for n in queries if n.startswith("op") and n[2].isdigit() and not n.startswith(("op4", "op7"))):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
"""


def test_every_operator_runs_without_the_package_on_executors(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    names = [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")]
    assert done.returncode == 0 and len(names) == 11, done.stderr[-2000:]
