"""Every registered query against its SQL counterpart on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

OWN = set(entry.catalog.load())  # queries of optional subpackages have their own tests
QUERIES = {k: f for k, f in entry.queries().items() if k in OWN}
SQL = {k: s for k, s in entry.oracle_sql().items() if k in OWN}
ROWS_ONLY = {"lasso_autoregression", "pooled_quantile_regression", "learned_backtest", "learned_metric_cube", "learned_significance", "learned_window_summary"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for table in check.TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return c


def test_every_query_has_sql_except_the_learned_models():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows_of(got) == check.rows_of(want)
