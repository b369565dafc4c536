from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import session

    s = session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small() -> str:
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
