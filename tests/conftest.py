import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from lodegraph import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.local_session(4, shuffle=4, app="tests")
    s.sparkContext.setLogLevel("OFF")
    return s
