"""The driver contract from a job that was started elsewhere."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
START = "from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()"


@pytest.mark.parametrize("first", ["session", "import"])
def test_workers_find_the_package(tmp_path, first):
    lines = [f"import sys; sys.path.insert(0, {REPO!r})", *([START, "import __spark_entry__ as e"] if first == "session" else ["import __spark_entry__ as e", START]), "print(len(e.queries()['title_similarity'](spark, '/root/testdata/sf0.001').collect()), 'rows')"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", "\n".join(lines)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.strip().endswith("rows"), out.stderr[-2000:]
