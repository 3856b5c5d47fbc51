import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quire.session import build_session

    session = build_session("tests", "8", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a frame as a sorted list of plain tuples."""

    def run(df, *columns):
        got = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in got.collect()), key=repr)

    return run
