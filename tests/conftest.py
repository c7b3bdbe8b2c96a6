import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from warnloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def report(spark):
    """A function that makes a report table from texts, numbered from 1."""

    def make(*texts):
        rows = [(i, f"r{i}.txt", text) for i, text in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "report_id BIGINT, filename STRING, text STRING")

    return make
