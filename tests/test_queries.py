"""Every query with SQL gives the rows that the SQL gives."""

import pytest

from evigraph.plans import catalog
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.SQL:
        wanted = duck.sql(catalog.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)
