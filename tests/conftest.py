import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from longweave.session import local_session

    return local_session("tests", 8)


@pytest.fixture(scope="session")
def sf():
    return SF
