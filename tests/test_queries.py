import os

import pytest

from tessera.plans import catalog

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert_same(df, catalog.ORACLE_SQL[name], SF)
    else:
        assert df.count() >= 0
