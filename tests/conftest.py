import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sievelark.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = make_session("tests", cores=8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
