import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from locations import ROOT  # noqa: E402

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from ticketlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()
