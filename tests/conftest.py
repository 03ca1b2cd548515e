import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cadenza.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain tuples, sorted when an order is named."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
