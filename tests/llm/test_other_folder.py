"""Every query runs on workers that cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from labelflow.session import build_session
spark = build_session(master="local[4]", shuffle_partitions=4)
for name, query in E.queries().items():
    if name.startswith("op") and "_" in name and name[2:name.index("_")].isdigit() or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_queries_run_from_an_unrelated_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    ran = [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")]
    assert len(ran) == 14 and "pipeline" in ran, (ran, done.stderr[-2000:])
