import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and all(0 <= value <= 1 for value in rows[0])


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    problem, _ = compare(spark, duck, name, SF_DIR)
    assert problem is None
