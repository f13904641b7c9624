import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = os.environ.get("LAKEWEAVE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lakeweave.session import get_spark

    session = get_spark("tests", cores=int(os.environ.get("TEST_CPUS", "4")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
