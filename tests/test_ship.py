"""The package reaches workers that cannot import it from the driver's folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from orgweft.session import session, ship

SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark = session(**{{"spark.ui.enabled": "false"}})
ship(spark)

def seen(batches):
    import orgweft.functions.ids as found
    for batch in batches:
        yield batch.assign(file=found.__file__)

files = {{r.file for r in spark.range(4).mapInPandas(seen, "id bigint, file string").collect()}}
assert len(files) == 1 and "orgweft.zip" in files.pop()
print("shipped")
"""


def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=str(REPO))],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240,
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]
