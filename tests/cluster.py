"""Runs queries on separate executor processes that do not have the package on their path."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF

_RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
known = e.queries()
for name in {names!r}:
    print(name, known[name](spark, {sf!r}).count(), flush=True)
"""


def counts(names: list[str], folder) -> dict[str, int]:
    """Rows of each query."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = _RUN.format(root=str(ROOT), names=names, sf=SF, shared=str(folder / "shared"))
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=folder, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return {x[0]: int(x[1]) for line in done.stdout.splitlines() if len(x := line.split()) == 2 and x[1].isdigit()}
