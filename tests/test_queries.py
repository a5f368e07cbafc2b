"""Every query of the catalog against its SQL."""

from __future__ import annotations

import compare
import pytest

from millrace.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    assert not compare.difference(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
