import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexspark.session import local_session, sweep  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    sweep(session)


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
