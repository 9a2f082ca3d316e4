"""Registered queries against their SQL answers, in DuckDB over the same tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from hazemeter.plans import catalog, oracle

duckdb = pytest.importorskip("duckdb")

# Lists are compared as they are in the flat form.
COMPARED = sorted(catalog.queries().keys() & oracle.statements().keys())


def normal(df: pd.DataFrame) -> list:
    def cell(value):
        if pd.isna(value):
            return "null"
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    cols = sorted(df.columns)
    return [cols, *sorted(([cell(v) for v in row] for row in df[cols].astype(object).values.tolist()), key=str)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert normal(got) == normal(want)


def test_every_query_has_an_answer():
    assert set(catalog.queries()) - set(oracle.statements()) == {"q1_results_nested"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).columns == [
        "batch_seq_id", "position", "city", "avg_improvement", "current_p1", "current_p2"
    ]
