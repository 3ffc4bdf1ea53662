import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagequarry.session import local_session

    session = local_session(checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["sf0.001", "sf0.01", "sf0.1"])
def folder(request):
    return f"{TESTDATA}/{request.param}"
