"""Queries on workers that hold no copy of this package: a driver started in another folder, without PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from ledgerloom.session import session
import __spark_entry__
spark = session("clean", master="local[4]", shuffle_partitions=4)
spark.sparkContext.setLogLevel("ERROR")
known = __spark_entry__.queries()
for name in sys.argv[3:]:
    known[name](spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
spark.stop()
"""


def run_clean(names: list[str], sf_dir: str, folder: Path) -> None:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (folder / "run.py").write_text(SCRIPT)
    found = subprocess.run([sys.executable, folder / "run.py", ROOT, sf_dir, *names], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    assert [line[4:] for line in found.stdout.splitlines() if line.startswith("ran ")] == names, found.stderr[-3000:]
