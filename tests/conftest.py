import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from placeloom.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__host="127.0.0.1",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
