import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("SATCHEL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from satchel.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"
