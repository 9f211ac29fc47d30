"""Each query with SQL against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from quire import catalogue


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("NULL" if v is None or v != v else str(v) for v in row) for row in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    found = rows_of(catalogue.QUERIES[name](spark, sf).toPandas())
    assert found == rows_of(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0


def test_scans_only_what_it_needs(spark, sf, capsys):
    catalogue.QUERIES["source_totals"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "text" not in plan.split("ReadSchema")[1].splitlines()[0]
