import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures  # noqa: E402
import pytest  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return fixtures.documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return fixtures.documents(spark, [])
