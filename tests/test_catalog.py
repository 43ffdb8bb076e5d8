"""Every registered query against its SQL; those without SQL run to their last row."""

import pytest
from compare import same

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs(spark, name):
    assert len(catalog.queries()[name](spark, SF).collect()) > 0
