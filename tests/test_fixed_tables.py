"""Operators on small fixed tables that hold every case."""

import pytest
from compare import assert_same
from fixed_tables import FIXED


@pytest.mark.parametrize("name", sorted(FIXED))
def test_fixed_table(spark, sf_dir, name):
    function, sql = FIXED[name]
    assert_same(function(spark), sf_dir, sql)
