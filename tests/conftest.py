import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    from asofkit.session import local_session

    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
