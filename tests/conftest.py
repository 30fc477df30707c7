import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from outcomelens.session import build_session
    s = build_session("local[4]", app="outcomelens-tests", shuffle_partitions=4, driver_memory="6g",
                      checkpoint_dir=tempfile.mkdtemp(prefix="outcomelens-tests-"))
    yield s
    s.stop()
