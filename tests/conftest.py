import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewarden.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Force hot-key splitting with tiny segments."""
    from tidewarden.operators.segments import ROWS_CONF

    spark.conf.set(ROWS_CONF, "7")
    yield
    spark.conf.unset(ROWS_CONF)
