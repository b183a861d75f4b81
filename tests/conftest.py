import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from judgeline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session


@pytest.fixture
def table(spark):
    """table(schema, rows): a small DataFrame."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
