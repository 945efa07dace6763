import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfsift.session import local_session, ship_package

    session = local_session("*", "shelfsift-tests", "8g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL
