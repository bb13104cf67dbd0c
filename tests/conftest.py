import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from severa.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
