"""Deployment regression: queries whose work runs in Python workers must not
depend on the driver's working directory or on Spark defaults (the package is
shipped with addPyFile; the checkpoint fallback must not set core confs)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("ROWS", q["knn_top1_join"](s, "/root/testdata/sf0.001").count(),
      q["scan_vectors"](s, "/root/testdata/sf0.001").count(), flush=True)
s.stop()
"""


def test_worker_queries_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="rivalry-cwd-")
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="rivalry-conf-"))
    env.pop("PYTHONPATH", None)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=900)
    assert "ROWS 100 500" in out.stdout, out.stderr[-2000:]
