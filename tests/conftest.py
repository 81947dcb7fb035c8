import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sieveworks.session import local_session

    s = local_session("tests", threads=4, partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
