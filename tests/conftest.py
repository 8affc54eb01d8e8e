import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column expression over one row of named values."""

    def run(expression, **columns):
        row = spark.createDataFrame([tuple(columns.values()) or (1,)], ", ".join(f"{c} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for c, v in columns.items()) or "x int")
        return row.select(expression.alias("v")).collect()[0]["v"]

    return run
