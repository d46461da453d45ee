"""Registered corpus queries against their SQL, and that nothing else needs the subpackage."""

import importlib.util
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from slotledger.llm import queries

ROOT = Path(__file__).resolve().parents[2]
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


def test_every_operator_has_one_query():
    names = set(queries.QUERIES)
    assert names <= set(entry.queries()) and set(queries.SQL) <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names - {"pipeline"}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and check.rows_of(got) == check.rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_returns_its_columns(spark, sf, name):
    want = {
        "op2": "shard slot byte_offset doc_id piece length ids_crc32", "op3": "doc_id n_lines n_cut text_sha256",
        "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next n_hashes",
        "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept distance", "op8": "doc_id fingerprint component_id",
        "op9": "doc_id piece start length ids_crc32 sequence_id offset", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op11": "vec_id component n deviation whitened explained identity_error",
        "op13": "doc_id n_bytes n_removed n_spans kept_sha256",
        "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
    }
    got = entry.queries()[name](spark, sf)
    assert " ".join(got.columns) == want[name.split("_")[0]]
    assert got.count() >= 100


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "slotledger").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
