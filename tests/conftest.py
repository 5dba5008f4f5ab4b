import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidelog.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 4, "tests", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
