import os
import sys

# small matrices: one thread each, as executors have it; set before numpy is loaded
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    return local_session(8, "6g")
