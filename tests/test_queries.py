"""Each registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import catalogue, catalogue_dataset, catalogue_generated, catalogue_more, catalogue_population  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run_twice_alike(spark, name):
    a, b = catalogue.QUERIES[name](spark, SF), catalogue.QUERIES[name](spark, SF)
    assert rows(a.columns, a.collect()) == rows(b.columns, b.collect()) != []
