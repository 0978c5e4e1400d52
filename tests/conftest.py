import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quantloom.session import session

    tmp = tempfile.mkdtemp(prefix="spark-")
    s = session("local[4]", 4, f"{tmp}/checkpoints", spark__ui__enabled="false", spark__local__dir=tmp, spark__sql__warehouse__dir=f"{tmp}/warehouse", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
