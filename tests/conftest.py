import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    return local_session("tests", 8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
