"""The SQL of the operators that SQL can express."""

import pytest

from stancewise.llm import queries
from tests.test_oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")
