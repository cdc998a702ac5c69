"""Every query against its SQL; those without SQL run and have unique, stable rows."""

from __future__ import annotations

import pytest
from compare import database, of_spark, of_sql

from evidencegraph import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return database(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_rows_match_sql(spark, duck, name):
    assert of_spark(QUERIES[name](spark, SMALL)) == of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_repeat(spark, name):
    first = of_spark(QUERIES[name](spark, SMALL))
    assert first[1] and first == of_spark(QUERIES[name](spark, SMALL))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
