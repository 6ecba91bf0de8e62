import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runledger.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, 4)


@pytest.fixture
def rows():
    """Sorted plain tuples of a frame's columns, for comparing whole results."""

    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return take
