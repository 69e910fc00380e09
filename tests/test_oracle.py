"""Every registered query of the booking model against its checking statement at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tallyslot import catalog
from tallyslot.oracle import statements
from tests.compare import DATA, connect, differences

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches_sql(spark, con, name):
    df = catalog.run(name, spark, FOLDER)
    assert differences(df, con, statements.oracle_sql()[name]) == []


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(statements.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
