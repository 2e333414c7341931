"""What Python workers hold once their tasks have ended."""

import os
import re
import subprocess
import sys
from pathlib import Path

#: In a session of its own, as workers of other tests would count.
RUN = r"""
import os, re
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from lakemill.llm import substring_dedup

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 8).getOrCreate()
random = np.random.default_rng(5)
rows = [(i, " ".join(f"w{x}" for x in random.integers(0, 10**6, 3000))) for i in range(1000)]
spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet("docs")
assert substring_dedup.cut_repeats(spark.read.parquet("docs")).where("length(text) > 0").count() == len(rows)
for p in Path("/proc").glob("[0-9]*"):
    try:
        if b"pyspark.daemon" in (p / "cmdline").read_bytes() and os.readlink(p / "cwd") == os.getcwd():
            print("MB", int(re.search(r"Pss_Anon:\s+(\d+)", (p / "smaps_rollup").read_text())[1]) // 1024)
    except OSError:  # it has ended
        pass
"""


def test_waiting_workers_hold_no_blocks(tmp_path):
    """A block's parses take tens of MB of a worker; once they are done with, the worker is near its least size."""
    root = str(Path(__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    held = [int(x) for x in re.findall(r"^MB (\d+)", done.stdout, re.M)]
    assert len(held) >= 2, done.stderr[-2000:]
    assert max(held) < 95, held
