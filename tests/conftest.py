import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ridewave.session import local_session

    os.environ.setdefault("RIDEWAVE_DRIVER_MEMORY", "6g")
    session = local_session(4, 4)
    yield session
    session.stop()
