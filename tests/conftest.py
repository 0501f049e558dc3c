import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shuffle_only(monkeypatch):
    """No table counts as small: every join takes the way for large sides."""
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)


def rows(df):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
