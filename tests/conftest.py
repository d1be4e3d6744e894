import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    s = get_session("tests", cores=4, partitions=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
