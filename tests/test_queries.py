"""Every registered query with SQL agrees with DuckDB; the others give rows of a stable schema."""

import numbers

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tallyloom.plans import catalog
from tallyloom.sources.tables import NAMES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def rows(d):
    show = lambda v: "" if pd.isna(v) else (str(round(float(v), 6)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v))
    return sorted(tuple(show(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    want, got = duck.execute(catalog.ORACLES[name]).df(), catalog.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and df.schema == catalog.QUERIES[name](spark, SMALL).schema


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
