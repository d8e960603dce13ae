import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from skylattice.session import local_session

    session = local_session(8, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from skylattice.queries import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture
def value(spark):
    """Evaluates a column without input."""
    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return evaluate


@pytest.fixture
def values(spark):
    """Evaluates several columns without input in one go."""
    def evaluate(*columns):
        return tuple(spark.range(1).select(*(c.alias(f"v{i}") for i, c in enumerate(columns))).first())

    return evaluate
