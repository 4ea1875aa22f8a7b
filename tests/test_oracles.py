"""Every registered query against its DuckDB twin (rows only where there is none)."""

import pytest
from compare import compare

from askloom.plans import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf):
    rows, message = compare(spark, con, sf, QUERIES[name])
    assert not message, message
    assert rows > 0
