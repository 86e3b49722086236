"""Every registered query of the library against its reference SQL. ``python tests/compare.py`` takes any folder of tables."""

import pytest

from compare import difference
from workload.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_reference(spark, con, tables, name):
    assert difference(spark, con, tables, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_a_reference():
    assert set(QUERIES) == set(ORACLES)
