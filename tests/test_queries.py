"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from quernflow.plans import catalog
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracles().get(name)
    if sql is None:
        assert len(got)
    else:
        assert_same(got, connect(sf).sql(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
