import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vendorlytics.session import build_session, checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="vendorlytics-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (NULL-safe ordering) for order-insensitive checks."""
    data = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return sorted(data, key=lambda t: tuple((v is None, str(v)) for v in t))
