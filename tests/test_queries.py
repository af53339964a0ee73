"""Every query against its SQL on the smallest tables; those without SQL must run and be stable in schema."""

import pytest

import __spark_entry__ as entry
from compare import both
from taxaflow.plans import data_queries, reference_queries

CORE = {**reference_queries.QUERIES, **data_queries.QUERIES}
SQL = {**reference_queries.SQL, **data_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    mine, theirs = both(spark, small, CORE[name], SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, small, name):
    df = CORE[name](spark, small)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_rows_are_lost_to_empty_answers(spark, small):
    for name in ("p3_found", "p4_found", "p5_found", "p6_found", "j1_taxonomy", "j18_nearest_blocks", "a9_knn_vote"):
        assert CORE[name](spark, small).limit(1).count() == 1, name
