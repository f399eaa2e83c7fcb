"""Every registered query against its SQL; those without SQL must run and return rows."""

import pytest
from compare import database, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "split", "model_input", "model_output"] and df.count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    assert len(got) > 0
    if sql is not None:
        assert difference(got, con.execute(sql).df()) is None
