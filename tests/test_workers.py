"""Python-side operators must work when the caller's working directory is
not the repository (workers then import the package shipped by addPyFile)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.queries()["embed_onnx"](spark, "/root/testdata/sf0.001").count())
print("TOPK", E.queries()["topk_embeddings"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_operators_from_other_cwd():
    cwd = tempfile.mkdtemp(prefix="lumenvec-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 12800" in out.stdout, out.stderr[-2000:]
    assert "TOPK 2500" in out.stdout, out.stderr[-2000:]
