import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from faultline.session import build_session, prepare  # noqa: E402

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = prepare(build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def at():
    return lambda seconds: T0 + timedelta(seconds=seconds)
