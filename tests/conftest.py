from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opslens.session import local_session, run_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """What the tests store lies below pytest's own folder, and is gone when they end."""
    folder = tmp_path_factory.mktemp("checkpoint")
    session = local_session(cores=8, memory="4g", spark__checkpoint__dir=str(folder))
    session.sparkContext.setLogLevel("ERROR")
    with run_folder(session) as path:
        yield session
    assert not os.path.exists(path.removeprefix("file:"))
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, b string", [(1, "x")])"""

    def make(ddl: str, rows: list):
        return spark.createDataFrame(rows, ddl)

    return make
