"""The queries of the training-data operators that SQL can express."""

import pytest
from compare import assert_same

from locusmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])
