import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from eventmine.session import get_spark  # noqa: E402
from support import make_events  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 8)
    yield s


@pytest.fixture
def ev(spark):
    return lambda rows: make_events(spark, rows)
