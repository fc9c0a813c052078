"""Joins, row changes, windows, masking and the read-only guard on hand-made frames with nulls, ties and empty inputs."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.functions import security as S
from tidewright.operators import dml, joins, quality
from tidewright.sources import catalog
from tidewright.sources.tables import demo_warehouse
from tidewright.streaming import windows as W


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_join_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c"), (None, 3, "d")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 10, 2.0), (1, 10, 3.0), (1, 11, 9.0), (3, 1, 4.0)], "k int, s int, v double")
    assert got(joins.asof_join(left, right, "k", "t", "s", ["v"])) == got(spark.createDataFrame([(1, 10, "a", 3.0), (1, 5, "b", 1.0), (2, 7, "c", None), (None, 3, "d", None)], "k int, t int, x string, v double"))
    assert joins.asof_join(left.where("false"), right, "k", "t", "s", ["v"]).count() == 0


def test_band_join_equals_the_plain_condition(spark):
    left = spark.range(100).select((F.col("id") * 7 % 53 - 10).cast("double").alias("v"))
    right = spark.createDataFrame([(1, -10.0, 3.0), (2, 3.0, 3.0), (3, 2.5, 40.0), (4, 100.0, 200.0), (5, 9.0, 8.0)], "i int, low double, high double")
    want = left.crossJoin(right).where("v >= low AND v < high")
    assert got(joins.band_join(left, right, "v", "low", "high", 7.0).select("v", "i")) == got(want.select("v", "i"))


def test_salted_join_keeps_every_pair(spark):
    left, right = spark.createDataFrame([(1, "a")] * 20 + [(2, "b")], "k int, x string"), spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, y string")
    assert got(joins.salted_join(left, right, "k", 5)) == got(left.join(right, "k"))
    assert got(joins.salted_join(left, right, "k", 5, "left")) == got(left.join(right, "k", "left"))
    with pytest.raises(ValueError):
        joins.salted_join(left, right, "k", 5, "full")


def test_not_in_has_the_nulls_of_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    rights = {"some": [(2,), (3,)], "null": [(3,), (None,)], "none": []}
    left.createOrReplaceTempView("not_in_left")
    for name, rows in rights.items():
        right = spark.createDataFrame(rows, "v int")
        right.createOrReplaceTempView("not_in_right")
        assert got(joins.not_in(left, right, "k", "v")) == got(spark.sql("SELECT k FROM not_in_left WHERE k NOT IN (SELECT v FROM not_in_right)")), name


def test_row_changes_and_null_conditions(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert got(dml.delete_where(t, F.col("v") == "a")) == got(t.where("k > 1"))
    assert got(dml.update_where(t, F.col("v") == "a", {"v": F.lit("z")})) == got(spark.createDataFrame([(1, "z"), (2, None), (3, "c")], "k int, v string"))
    s = spark.createDataFrame([(2, "new", False), (3, "x", True), (4, "d", False), (5, "e", True)], "k int, v string, gone boolean")
    assert got(dml.merge(t, s, ["k"], delete_flag="gone")) == [(1, "a"), (2, "new"), (4, "d")]
    assert got(dml.merge(t, s, ["k"], insert=False)) == [(1, "a"), (2, "new"), (3, "x")]
    assert got(dml.incremental_append(t.where("k < 2"), t, "k", "k")) == got(t) and got(dml.incremental_append(t.where("false"), t, "k", "k")) == got(t)


def test_windows_at_their_edges(spark):
    at = lambda *m: [(1, datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=x)) for x in m]
    e = spark.createDataFrame(at(0, 30, 61, 119, 120), "u int, ts timestamp")
    n = F.count(F.lit(1)).alias("n")
    assert sorted(r.n for r in W.session(e, "ts", "30 minutes", ["u"], n).collect()) == [1, 2, 2]
    assert sorted(r.n for r in W.tumble(e, "ts", "2 hours", ["u"], n).collect()) == [1, 4]
    grown = {(r.window_start.hour, int((r.window_end - r.window_start).seconds / 60)): r.n for r in W.cumulate(e, "ts", 60, 120, ["u"], n).collect()}
    assert grown == {(0, 60): 2, (0, 120): 4, (2, 60): 1, (2, 120): 1}
    kept = W.first_within(e, ["u"], "ts", "ts", 30 * 60)
    assert kept.count() == 3  # 0; 61 (31 minutes after 30); 119 (58 after 61)


def test_late_rows_go_however_the_order_is_cut(spark):
    base = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(k, base + datetime.timedelta(minutes=k * 37 % 101)) for k in range(100)], "k long, ts timestamp")
    want = []
    newest = None
    for k, ts in sorted(map(tuple, e.collect())):
        if newest is None or ts >= newest - datetime.timedelta(minutes=20):
            want.append((k, ts))
        newest = ts if newest is None else max(newest, ts)
    for rows in (7, 1000):
        assert sorted(map(tuple, W.drop_late(e, "k", "ts", "20 MINUTES", rows).collect())) == want
    assert W.drop_late(e.where("false"), "k", "ts", "20 MINUTES").count() == 0


def test_quality_counts_nulls_and_empty_tables(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None), (2, "z")], "k int, v string")
    assert tuple(quality.unique(t, ["k"]).first())[2:] == (5, 1) and tuple(quality.not_null(t, "k").first())[2:] == (5, 2)
    assert tuple(quality.accepted_values(t, "v", ["a", "b", "c"]).first())[2:] == (5, 1) and tuple(quality.between(t, "k", 2, 3).first())[2:] == (5, 2)
    assert tuple(quality.relationships(t, "k", spark.createDataFrame([(1,), (None,)], "p int"), "p").first())[2:] == (5, 1)
    none = t.where("false")
    assert tuple(quality.unique(none, ["k"]).first())[2:] == (0, 0) and tuple(quality.not_null(none, "k").first())[2:] == (0, 0)
    assert quality.freshness(none.withColumn("ts", F.current_timestamp()), "ts", F.current_timestamp(), 1).first().fresh is False


def test_pii_names_and_masks(spark):
    names = {"customerEmail": "email", "ssn_hash": None, "ship": None, "clip": None, "ip": "ip_address", "EMAIL_address": "email", "": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.pii_type(F.col("n")).alias("t"), S.mask_email(F.lit("ann@x.org")).alias("e"), S.mask_tail(F.lit("4111-1111"), 4).alias("c"))
    assert {r.n: r.t for r in df.collect()} == names and df.first().e == "a***@x.org" and df.first().c == "****-1111"


@pytest.mark.parametrize("text", ["DROP TABLE x", "INSERT INTO x SELECT 1", "DELETE FROM x", "UPDATE x SET a = 1", "CREATE TABLE x AS SELECT 1", "SELECT 1; DROP TABLE x", "WITH q AS (SELECT 1) INSERT INTO x SELECT * FROM q", "MERGE INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE", "ALTER TABLE x ADD COLUMN b INT", "", "/* SELECT */ TRUNCATE TABLE x"])
def test_only_queries_pass(spark, text):
    assert catalog.is_read_only(spark, text)[0] is False
    row = catalog.profile(spark, text).first()
    assert row.allowed is False and row.reason and catalog.history(spark, 1).first().query == text


def test_profiles_are_measured(spark):
    r = catalog.profile(spark, "WITH q AS (SELECT id FROM range(50)) SELECT id FROM q WHERE id < 20").first()
    assert r.allowed and r.rows_produced == 20 and r.estimated_bytes > 0 and r.elapsed_ms > 0


def test_demo_warehouse(spark):
    t = demo_warehouse(spark)
    assert {k: v.count() for k, v in t.items()} == {"raw.customers": 60, "raw.orders": 80, "raw.payments": 70, "raw.addresses": 60, "raw.excluded_statuses": 3, "analytics.enriched_orders": 48}
    assert dict(t["raw.orders"].dtypes)["amount"] == "decimal(12,2)"
