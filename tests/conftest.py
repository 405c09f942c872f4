import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lurelens.session import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("LURELENS_DRIVER_MEMORY", "6g")
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
