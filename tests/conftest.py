import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tipscope.session import local_session, shared_dir

    session = local_session("8", shuffle_partitions=4)
    shared_dir(session)
    yield session
    session.stop()
