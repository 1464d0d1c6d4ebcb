import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression over one row of named values."""
    from pyspark.sql import functions as F

    def run(build, *args):
        row = spark.createDataFrame([(1,)], "one int")
        columns = [F.lit(a) if not hasattr(a, "alias") else a for a in args]
        return row.select(build(*columns).alias("v")).first()["v"]

    return run
