import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestar.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="lodestar-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate one column expression over a single row of named values."""
    def run(make, **values):
        row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
        return row.select(make().alias("v")).first()["v"]

    return run
