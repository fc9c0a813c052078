"""Rows that the smallest tables don't hold: equal places in an order, null places, and numbers halfway between two whole ones."""

from __future__ import annotations

import datetime

import duckdb

from tidewright.plans import catalogue
from tidewright.streaming import windows as W

START = datetime.datetime(2024, 1, 1)


def test_late_rows_of_equal_arrival_are_seen_by_event_id(spark, tmp_path):
    ids = [k * 10007 + r for k in range(6) for r in (0, 1, 2)]  # arrivals 0, 7919 and 5831, six rows each
    hours = [90, 0, 120, 200, 10, 130, 30, 300, 5, 250, 400, 60, 1, 170, 90, 500, 350, 2]
    made = list(zip(ids, [START + datetime.timedelta(hours=h) for h in hours], strict=True))
    want = None
    for turn, rows in enumerate((made, made[::-1], made[7:] + made[:7])):  # whatever the rows' order in the file
        d = str(tmp_path / str(turn))
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{d}/events.parquet")
        events = duckdb.sql(f"SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")  # noqa: F841  read by the SQL
        sql = catalogue.ORACLE_SQL["late_data_drop"].replace("ORDER BY arrival", "ORDER BY arrival, event_id")
        want = want or sorted(duckdb.sql(sql).fetchall())
        assert sorted(map(tuple, catalogue.QUERIES["late_data_drop"](spark, d).collect())) == want
    assert 3 < len(want) < len(made)


def test_late_rows_without_a_place_come_last(spark):
    rows = [(1, 1, 100), (2, 2, 200), (3, None, 150), (4, None, 250), (5, None, 199)]
    e = spark.createDataFrame([(i, k, START + datetime.timedelta(minutes=m)) for i, k, m in rows], "i int, k long, ts timestamp_ntz")
    for each in (1, 100):
        assert sorted(r.i for r in W.drop_late(e, "k", "ts", "60 MINUTES", each, ("i",)).collect()) == [1, 2, 3, 4, 5]
        assert sorted(r.i for r in W.drop_late(e, "k", "ts", "20 MINUTES", each, ("i",)).collect()) == [1, 2, 4]
    assert sorted(r.i for r in W.drop_late(e.where("k IS NULL"), "k", "ts", "20 MINUTES", 1, ("i",)).collect()) == [3, 4]


def test_rank_rounds_halves_as_its_sql(spark, tmp_path):
    prices = [5000.0, 15000.0, 25000.0, 35000.0, 24999.99, 25000.01, 30000.0, 20000.0, -25000.0, None, None, 45000.0, 45000.0]
    rows = [(k if k else None, p, "12"[k % 2]) for k, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    orders = duckdb.sql(f"SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(catalogue.ORACLE_SQL["win_rank_partition"]).fetchall(), key=repr)
    assert sorted(map(tuple, catalogue.QUERIES["win_rank_partition"](spark, str(tmp_path)).collect()), key=repr) == want
