import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parley.session import build_session, ensure_checkpoint_dir

    s = build_session("local[4]", 8, app="parley-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
