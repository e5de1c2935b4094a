"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from feedforge.plans import queries as plans
from tests.compare import database, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, FOLDER).toPandas()
    if name in plans.oracle_sql():
        same(found, duck.sql(plans.oracle_sql()[name]).df())
    else:
        assert len(found)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
