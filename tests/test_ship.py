"""The queries run from any folder, without the package on the workers' path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["knn_l2"](spark, sys.argv[2]).count(), e.queries()["knn_l2"](spark, sys.argv[2]).count())
"""


def test_from_another_folder(small, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", CODE, ROOT, small], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 10 10" in out.stdout, out.stderr[-2000:]
