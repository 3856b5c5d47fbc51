"""Every registered query against its SQL twin on the given tables."""

import pytest

from quire.plans import load_all
from tools.check import compare, oracle

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name, REGISTRY[name])
    assert result.startswith(("ok", "rows only")), result
