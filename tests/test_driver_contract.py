"""The driver contract from outside the repository: a plain session (none of
this package's settings) in an unrelated working directory must run the
entry and the Arrow-UDF queries, i.e. Python workers never need the package
on their path."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("spark_entry", sys.argv[1])
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
print("entry", m.entry(spark).count())
qs = m.queries()
for k in ("closest_label", "fewshot_evaluate", "score_prompts", "similarity_topn"):
    print(k, qs[k](spark, sys.argv[2]).count())
spark.stop()
'''


def test_entry_and_udf_queries_from_another_folder(sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work = tempfile.mkdtemp(prefix="labelflow-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(root, "__spark_entry__.py"), sf_dir],
                         cwd=work, env=env, capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-3000:]
    lines = dict(line.split(" ", 1) for line in res.stdout.splitlines() if " " in line)
    assert {"entry", "closest_label", "fewshot_evaluate", "score_prompts", "similarity_topn"} <= set(lines)
