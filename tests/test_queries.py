"""Every registered query against its SQL, on the smallest data set."""

import check
import pytest
from conftest import SMALL

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def connection():
    return check.connect(SMALL)


def test_every_query_has_its_sql():
    assert entry.QUERIES.keys() == entry.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", entry.QUERIES)
def test_query(spark, connection, name):
    assert check.compare(spark, connection, name, SMALL) == ""
    plan = entry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


def test_entry(spark):
    books = entry.entry(spark)
    assert books.count() == 200 and len(books.columns) == 50
