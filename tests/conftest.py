import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="quire-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples (selected columns, sorted)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
