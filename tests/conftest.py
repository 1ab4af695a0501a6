import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from brindle.session import local_session

    session = local_session(4, 4, "brindle-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
