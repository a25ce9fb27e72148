"""Every registered query against its DuckDB SQL on the same parquet
tables (smallest scale; the driver repeats this at sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle import SF_SMALL, compare, duck

from recensio.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_is_registered_with_callable():
    assert set(ORACLE) <= set(QUERIES) and QUERIES.keys() <= E.queries().keys() and ORACLE.keys() <= E.oracle_sql().keys()
    assert len(QUERIES) >= 57


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_schema_is_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() >= 0
