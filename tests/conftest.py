import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import local_session

    session = local_session(8, shuffle_partitions=4, app="threadloom-tests")
    yield session
    session.stop()
