"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from tidewright.plans import catalogue
from tidewright.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(want.columns, want.fetchall())


def test_names_are_unique_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name,table", [("join_cast_key", "orders"), ("date_functions", "orders"), ("io_text_round_trip", "customer"), ("merge_upsert", "customer")])
def test_whole_tables_go_in(spark, sf_dir, duck, name, table):
    assert catalogue.QUERIES[name](spark, sf_dir).count() == duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]


def test_null_keys_of_whole_tables_meet(spark, sf_dir, duck):
    got = {r.nationkey: r.pairs for r in catalogue.QUERIES["join_null_safe"](spark, sf_dir).collect()}
    assert got[None] == duck.sql("SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) * (SELECT count(*) FROM supplier WHERE s_nationkey = 3)").fetchall()[0][0] > 0
