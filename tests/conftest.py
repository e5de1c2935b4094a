from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedforge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "3"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
