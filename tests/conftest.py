import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.sources.tables import Tables

    return Tables(spark, SF)


def rows(df, *order):
    """Rows as tuples in a fixed order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
