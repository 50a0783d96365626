import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prepkit.functions.sizing import RANGE_ROWS_CONF  # noqa: E402
from prepkit.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def scaled(spark):
    """Small ranges, as many as a large table has."""
    spark.conf.set(RANGE_ROWS_CONF, "60")
    yield spark
    spark.conf.unset(RANGE_ROWS_CONF)


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
