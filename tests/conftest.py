import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compoundry.plans.registry import ship_package
    from compoundry.session import local_session

    session = local_session("4", "compoundry-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    ship_package(session)
    yield session
    session.stop()
