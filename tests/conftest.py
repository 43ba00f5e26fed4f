import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = ":".join(x for x in (str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from shutterloom.session import local_session

    return local_session("8", 8)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
