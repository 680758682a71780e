from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from roadworthy.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="roadworthy-tests")
    yield s
    s.stop()


def rows(df, *order):
    """Collect as a list of dicts, sorted for stable comparison."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda d: tuple((d[k] is None, d[k]) for k in order))
    return out
