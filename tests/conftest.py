import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from noticegrid.session import local_session

    return local_session("8", "tests")


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def inputs(spark, data):
    from noticegrid.plans.views import Inputs

    return Inputs(spark, data)
