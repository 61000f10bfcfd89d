import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tenure.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="tenure-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def rows(df, order=None):
    """Collect as a list of dicts (sorted by ``order`` columns when given)."""
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple(r[c] for c in order))
    return out
