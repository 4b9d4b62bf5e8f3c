"""Every registered query against its SQL, or at least its shape."""

import pytest
from compare import assert_same

from pagemill.plans import catalog, details, measures, pictures, places, reports, runs  # noqa: F401  the others add their queries to the catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLE:
        assert_same(df, catalog.ORACLE[name], FOLDER)
    else:
        assert df.count() > 0
