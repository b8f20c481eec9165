import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from stowage.session import session

    made = session("tests", 4, 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
