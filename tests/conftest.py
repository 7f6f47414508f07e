import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wickspark.session import local_session
    return local_session(8, "tests", "8g")


@pytest.fixture()
def folder(tmp_path_factory):
    import tempfile
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
