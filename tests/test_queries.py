"""Every registered query against its SQL."""

import pytest
from conftest import SF, same_as_sql

from keelvault.queries import base, build, checks

assert build and checks


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    if name in base.ORACLES:
        same_as_sql(df, duck, base.ORACLES[name])
    else:
        assert df.count() > 0
