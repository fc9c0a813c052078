"""Relational operators over the star schema, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dml, joins
from ..sources.tables import demo_warehouse, read, register
from .registry import Registry

R = Registry()
c = F.col
MONEY = "decimal(18,2)"


def exact(col: str, kind: str = MONEY) -> Column:
    """Sums of doubles depend on their order; sums of decimals don't."""
    return F.sum(c(col).cast(kind)).cast("double")


SQL_REVENUE = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"


def net() -> Column:
    return (c("l_extendedprice") * (1 - c("l_discount"))).cast("decimal(18,4)")


def revenue() -> Column:
    return F.sum(net()).cast("double")


# ---- scans, projections, filters


@R.query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS gross FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where(c("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", (c("l_extendedprice") * c("l_quantity")).alias("gross"))


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P' AND 1000 <= o_custkey")
def filter_cmp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where((c("o_totalprice") > 200000) & (c("o_orderstatus") != "P") & (F.lit(1000) <= c("o_custkey"))).select("o_orderkey", "o_totalprice")


@R.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_tax NOT BETWEEN 0.02 AND 0.06")
def filter_between(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where(c("l_quantity").between(10, 12) & ~c("l_tax").between(0.02, 0.06)).select("l_orderkey", "l_linenumber", "l_quantity")


@R.query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY") & ~c("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@R.query("SELECT p_partkey, p_name FROM part WHERE p_type ILIKE 'promo%' OR p_name LIKE 'Part#1_%'")
def filter_like_ilike(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(c("p_type").ilike("promo%") | c("p_name").like("Part#1_%")).select("p_partkey", "p_name")


@R.query("SELECT r_regionkey, r_name FROM region WHERE r_name LIKE '%AMERICA%' OR r_name NOT LIKE '%A%'")
def filter_leading_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").where(c("r_name").like("%AMERICA%") | ~c("r_name").like("%A%"))


@R.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'")
def filter_or_to_in(spark: SparkSession, d: str) -> DataFrame:
    return joins.or_to_in(read(spark, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderpriority")


@R.query("WITH x AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT count(*) AS n_equal, (SELECT count(*) FROM x WHERE seg IS NULL) AS n_null FROM x WHERE seg = NULL")
def filter_null_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "customer").select("c_custkey", F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return x.agg(F.count_if(c("seg") == F.lit(None).cast("string")).alias("n_equal"), F.count_if(c("seg").isNull()).alias("n_null"))


@R.query("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
def star_except(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("customer",))
    return spark.sql("SELECT * EXCEPT (c_acctbal, c_name) FROM customer")


@R.query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-15'")
def sargable_date_range(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1996-03-15").cast("timestamp_ntz")
    return read(spark, d, "orders").where((c("o_orderdate") >= day) & (c("o_orderdate") < day + F.expr("INTERVAL 1 DAY"))).select("o_orderkey", "o_orderdate")


@R.query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, CASE WHEN c_acctbal > 9000 THEN 'top' END AS top FROM customer")
def case_when(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.when(c("c_acctbal") < 0, "debt").when(c("c_acctbal") < 5000, "low").otherwise("high").alias("band"), F.when(c("c_acctbal") > 9000, "top").alias("top"))


@R.query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n, CAST(value AS BIGINT) AS whole FROM (SELECT event_id, floor(value) AS value FROM events)")
def cast_try_cast(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(c("event_id") % 3 == 0, F.concat(F.lit("x"), c("event_id").cast("string"))).otherwise(c("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", text.try_cast("bigint").alias("n"), F.floor("value").cast("bigint").alias("whole"))


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k > 50")


@R.query("WITH x AS (SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, seg, seg IS NULL AS missing FROM x WHERE seg IS NULL OR c_acctbal >= 0")
def filter_is_null(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return x.where(c("seg").isNull() | (c("c_acctbal") >= 0)).select("c_custkey", "seg", c("seg").isNull().alias("missing"))


@R.query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) - 7 AS week_before FROM orders")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.trunc(c("o_orderdate").cast("date"), "month").alias("month"), F.date_sub(c("o_orderdate").cast("date"), 7).alias("week_before"))


# ---- joins


@R.query(f"SELECT n_name, {SQL_REVENUE} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    by_supplier = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(net()).alias("r"))  # before the join
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return by_supplier.join(s, by_supplier["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.sum("r").cast("double").alias("revenue"))


@R.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'P'")
    return read(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@R.query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where("c_nationkey < 5").join(read(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "right").select("o_orderkey", "c_custkey")


@R.query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_suppkey END AS k FROM supplier) ON c_custkey = k")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.when(c("s_acctbal") >= 0, c("s_suppkey")).alias("k"))
    return read(spark, d, "customer").join(s, c("c_custkey") == c("k"), "full").select("c_custkey", "s_suppkey")


@R.query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").crossJoin(read(spark, d, "nation")).select("r_name", "n_name")  # both tables are fixed in size


@R.query("SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 300000")
def join_comma_where(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("customer", "orders"))
    return spark.sql("SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 300000")


@R.query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(c("n_regionkey").alias("k"), "n_name").join(read(spark, d, "region").select(c("r_regionkey").alias("k"), "r_name"), ["k"])


@R.query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("nation", "region"))
    return spark.sql("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")


@R.query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 150000)")
def join_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 150000")
    return read(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@R.query("""WITH few AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000), nul AS (SELECT k FROM few UNION ALL SELECT NULL)
SELECT 'without null' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM few) UNION ALL SELECT 'with null', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM nul)""")
def join_not_in_null_aware(spark: SparkSession, d: str) -> DataFrame:
    customers, few = read(spark, d, "customer"), read(spark, d, "orders").where("o_totalprice > 250000").select(c("o_custkey").alias("k"))
    counted = lambda right, side: joins.not_in(customers, right, "c_custkey", "k").agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return counted(few, "without null").unionAll(counted(few.unionAll(spark.sql("SELECT CAST(NULL AS BIGINT) AS k")), "with null"))


BANDS = "VALUES ('a', 0.0, 1000.0), ('b', 900.0, 2500.0), ('c', 2400.0, 2400.0), ('d', 8000.0, 20000.0)"


@R.query(f"SELECT band, count(*) AS n FROM customer JOIN ({BANDS}) AS b(band, low, high) ON c_acctbal >= low AND c_acctbal < high GROUP BY band")
def join_range_theta(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.sql(f"SELECT band, double(low) AS low, double(high) AS high FROM {BANDS} AS b(band, low, high)")
    return joins.band_join(read(spark, d, "customer"), bands, "c_acctbal", "low", "high", 1000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH a AS (SELECT nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT nullif(s_nationkey, 3) AS k FROM supplier)
SELECT a.k AS nationkey, count(*) AS pairs FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k""")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    counted = lambda t, k, n: read(spark, d, t).groupBy(F.nullif(c(k), F.lit(3)).alias(f"{n}_k")).agg(F.count(F.lit(1)).alias(n))  # noqa: E731  before the join, so that the NULL key is one row
    a, b = counted("customer", "c_nationkey", "a"), counted("supplier", "s_nationkey", "b")
    return a.join(b, c("a_k").eqNullSafe(c("b_k"))).select(c("a_k").alias("nationkey"), (c("a") * c("b")).alias("pairs"))


@R.query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_double(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("n1"), c("b.n_name").alias("n2"))


@R.query("SELECT o_orderkey, c_name FROM orders JOIN (SELECT c_name, CAST(c_custkey AS VARCHAR) AS k FROM customer) ON CAST(o_custkey AS VARCHAR) = k")
def join_cast_key(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "customer").select("c_name", c("c_custkey").cast("string").alias("k"))
    return read(spark, d, "orders").join(k, c("o_custkey").cast("string") == c("k")).select("o_orderkey", "c_name")


@R.query("SELECT r_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_broadcast_star(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")  # 25 and 5 rows at any scale
    return read(spark, d, "customer").join(F.broadcast(n), c("c_nationkey") == c("n_nationkey")).join(F.broadcast(r), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n_customers"))


@R.query("""WITH p AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS viewed FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, p.value, v.viewed FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", c("ts").alias("seen"), c("value").alias("viewed"))
    return joins.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), views, "user_id", "ts", "seen", ["viewed"]).drop("ts")


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderpriority")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("k"))
    return joins.salted_join(l, read(spark, d, "orders").select(c("o_orderkey").alias("k"), "o_orderpriority"), "k", 4).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def join_unnest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@R.query("SELECT r_name, o_orderkey, o_totalprice FROM region, LATERAL (SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def join_lateral_top3(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").join(read(spark, d, "customer"), c("o_custkey") == c("c_custkey")).join(read(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(read(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    w = Window.partitionBy("r_name").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("r_name", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


# ---- aggregation

Q1 = """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@R.query(Q1)
def agg_group_by(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(exact("l_quantity").alias("sum_qty"), exact("l_extendedprice").alias("sum_base"), revenue().alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@R.query("SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), exact("o_totalprice").alias("total"))


@R.query("SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_ordinal(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("orders",))
    return spark.sql("SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")


@R.query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id")
def agg_count_if(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "purchase").alias("purchases"), F.count_if(c("event_type") == "error").alias("errors"))


@R.query("SELECT o_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS finished FROM orders GROUP BY o_custkey")
def agg_filter_clause(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ("orders",))
    return spark.sql("SELECT o_custkey, double(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0)) AS finished FROM orders GROUP BY o_custkey")


@R.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 200000")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high")).where("n >= 15 AND high > 200000").drop("high")


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING o_orderpriority LIKE '%-%' AND o_orderpriority <> '5-LOW'")
def agg_having_without_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderpriority LIKE '%-%' AND o_orderpriority <> '5-LOW'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@R.query(f"SELECT l_suppkey, {SQL_REVENUE} AS revenue FROM lineitem GROUP BY l_suppkey")
def agg_expression_revenue(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(revenue().alias("revenue"))


@R.query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean_qty FROM lineitem GROUP BY l_returnflag")
def agg_avg(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg((exact("l_quantity") / F.count("l_quantity")).alias("mean_qty"))


for kind, clause in (("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    text = f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY {clause}"

    @R.query(text, name=f"agg_{kind}")
    def _(spark: SparkSession, d: str, text: str = text) -> DataFrame:
        register(spark, d, ("lineitem",))
        return spark.sql(text)


@R.query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\", count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).fillna(0, ["O", "F"])


@R.query(None)
def agg_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


# ---- windows


@R.query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def win_row_number_dedup(spark: SparkSession, d: str) -> DataFrame:
    newest = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))  # combines before the shuffle, unlike a window
    return newest.select("o_custkey", "x.o_orderkey", "x.o_orderdate")


@R.query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice / 10000 AS INTEGER) DESC)")
def win_rank_partition(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc(F.rint(c("o_totalprice") / 10000).cast("int")))  # halves go to the even number, as in the SQL's cast
    return read(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), F.asc_nulls_last("o_orderkey"))).alias("q"))


@R.query("SELECT event_id, lag(event_type) OVER w AS before, lead(value, 2, -1.0) OVER w AS two_later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("two_later"))


@R.query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3 FROM orders")
def win_running_sum_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return read(spark, d, "orders").select("o_orderkey", F.sum(c("o_totalprice").cast(MONEY)).over(w).cast("double").alias("last3"))


@R.query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS in_90_days FROM orders")
def win_range_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(c("o_orderdate").cast("date"))).rangeBetween(-90, 0)
    return read(spark, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("in_90_days"))


@R.query("SELECT n_name, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, rank() OVER (ORDER BY count(*) DESC, n_name) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def win_full_table(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))  # a window over all rows comes after the aggregation, over 25
    by = by.join(read(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return by.select("n_name", "n", (c("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.rank().over(Window.orderBy(F.desc("n"), "n_name")).alias("place"))


# ---- sort, limit, sets


@R.query(f"SELECT l_orderkey, {SQL_REVENUE} AS revenue FROM lineitem GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10")
def topk_revenue(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(revenue().alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@R.query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 5")
def order_limit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(5).limit(20)


@R.query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


SETS = {"union_all": ("UNION ALL", "unionAll"), "union_distinct": ("UNION", None), "intersect_keys": ("INTERSECT", "intersect"), "intersect_all_keys": ("INTERSECT ALL", "intersectAll"), "except_keys": ("EXCEPT", "subtract"), "except_all_keys": ("EXCEPT ALL", "exceptAll")}
for set_name, (word, method) in SETS.items():

    @R.query(f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {word} SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 20", name=set_name)
    def _(spark: SparkSession, d: str, method: str | None = method) -> DataFrame:
        a = read(spark, d, "customer").where("c_acctbal > 0").select(c("c_nationkey").alias("k"))
        b = read(spark, d, "supplier").where("s_nationkey < 20").select(c("s_nationkey").alias("k"))
        return getattr(a, method)(b) if method else a.union(b).distinct()


# ---- subqueries and CTEs


@R.query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS lifetime_orders FROM customer")
def scalar_subquery_lifetime_orders(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, d, "customer").join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("lifetime_orders"))


@R.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity * (SELECT count(*) FROM lineitem x WHERE x.l_partkey = l.l_partkey) < 0.2 * (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem x WHERE x.l_partkey = l.l_partkey)")
def correlated_avg(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    by = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), exact("l_quantity").alias("total"))
    return l.join(by, "l_partkey").where(c("l_quantity") * c("n") < 0.2 * c("total")).select("l_orderkey", "l_linenumber", "l_quantity")


@R.query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT 'above' AS side, count(*) AS k FROM t WHERE n > (SELECT avg(n) FROM t)
UNION ALL SELECT 'most', count(*) FROM t WHERE n = (SELECT max(n) FROM t) UNION ALL SELECT 'all', count(*) FROM t""")
def cte_reuse(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    by = t.groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # one pass; what the three parts need is a small histogram
    facts = by.agg(F.sum("k").alias("all"), F.max_by("k", "n").alias("most"), (F.sum(c("n") * c("k")) / F.sum("k")).alias("mean"), F.collect_list(F.struct("n", "k")).alias("h"))
    above = F.aggregate(F.filter("h", lambda x: x["n"] > c("mean")), F.lit(0).cast("bigint"), lambda a, x: a + x["k"])
    return facts.select(F.explode(F.array(F.struct(F.lit("above").alias("side"), above.alias("k")), F.struct(F.lit("most").alias("side"), c("most").alias("k")), F.struct(F.lit("all").alias("side"), c("all").alias("k")))).alias("x")).select("x.*")


@R.query("SELECT priority, max(n) AS busiest FROM (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) GROUP BY priority")
def derived_table(spark: SparkSession, d: str) -> DataFrame:
    by_day = read(spark, d, "orders").groupBy(c("o_orderpriority").alias("priority"), c("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return by_day.groupBy("priority").agg(F.max("n").alias("busiest"))


@R.query("SELECT DISTINCT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def in_subquery(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").join(read(spark, d, "customer").where("c_acctbal > 9500"), c("n_nationkey") == c("c_nationkey"), "left_semi").select("n_name").distinct()


@R.query("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
def recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, bigint(1) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


# ---- DML


@R.query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def ctas_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "nation").where("n_regionkey <> 2").createOrReplaceTempView("nation_slice")
    return spark.table("nation_slice")


@R.query("SELECT * FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "region").select((c("r_regionkey") + 100).alias("n_nationkey"), c("r_name").alias("n_name"), c("r_regionkey").alias("n_regionkey"))
    return read(spark, d, "nation").where("n_regionkey = 1").unionByName(new)


@R.query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region WHERE r_regionkey = 1")
def insert_overwrite_result(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "region").where("r_regionkey = 1").select((c("r_regionkey") + 100).alias("n_nationkey"), c("r_name").alias("n_name"), c("r_regionkey").alias("n_regionkey"))
    return dml.delete_where(read(spark, d, "nation"), c("n_regionkey") == 1).unionByName(new)


@R.query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.update_where(read(spark, d, "customer"), c("c_acctbal") < 0, {"c_mktsegment": F.lit("REVIEW"), "c_acctbal": F.lit(0.0)}).select("c_custkey", "c_mktsegment", "c_acctbal")


@R.query("SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) WHERE seg <> 'MACHINERY' OR seg IS NULL")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "customer").select("c_custkey", F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return dml.delete_where(x, c("seg") == "MACHINERY")


@R.query("""WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 5000), s AS (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_acctbal >= 0)
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v FROM t FULL JOIN s ON t.k = s.k""")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v"))
    return dml.merge(x.where("v < 5000"), x.where("v >= 0").withColumn("v", -c("v")), ["k"])


@R.query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return dml.incremental_append(o.where(c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), o, "o_orderkey", "o_orderdate")


# ---- the example pipelines


@R.query(f"""WITH life AS (SELECT o_custkey, count(*) AS lifetime_orders FROM orders GROUP BY o_custkey),
rev AS (SELECT o_custkey, {SQL_REVENUE} AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name AS nation, r_name AS region, revenue, lifetime_orders FROM customer JOIN rev ON rev.o_custkey = c_custkey JOIN life ON life.o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%AMERICA%' AND c_mktsegment NOT IN (SELECT s_name FROM supplier) ORDER BY revenue DESC, c_custkey LIMIT 100""")
def ex_tpch_top_customers(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").join(read(spark, d, "region").where(c("r_name").like("%AMERICA%")), c("n_regionkey") == c("r_regionkey"))
    customers = read(spark, d, "customer").join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey"))  # at most 25 rows
    customers = customers.join(read(spark, d, "supplier"), c("c_mktsegment") == c("s_name"), "left_anti").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", c("n_name").alias("nation"), c("r_name").alias("region"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers.select("c_custkey"), c("o_custkey") == c("c_custkey"), "left_semi")
    per_order = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(net()).alias("r"))
    per_customer = orders.join(per_order, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_custkey").agg(F.sum("r").cast("double").alias("revenue"), F.count(F.lit(1)).alias("lifetime_orders"))
    return customers.join(per_customer.where("revenue IS NOT NULL"), c("c_custkey") == c("o_custkey")).drop("o_custkey").orderBy(F.desc("revenue"), "c_custkey").limit(100)


@R.query("""WITH i AS (SELECT unnest(range(80)) AS i) SELECT i AS order_id, CAST(TIMESTAMP '2023-01-01' + INTERVAL (i * 7) HOUR AS TIMESTAMP) AS created_at,
'user' || (i % 60) || '@' || ['gmail.com', 'example.com', 'corp.io'][i % 60 % 3 + 1] AS customer_email, CAST(i * 13 % 500 + 10 AS DOUBLE) AS amount FROM i WHERE i % 5 NOT IN (2, 4)""")
def ex_orders_enriched(spark: SparkSession, d: str) -> DataFrame:
    return demo_warehouse(spark)["analytics.enriched_orders"].withColumn("amount", c("amount").cast("double"))


@R.query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, count(*) AS trips, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_tax
FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1998-03-15' AND l_quantity > 0 AND l_returnflag IN ('A', 'N', 'R') GROUP BY ALL""")
def ex_daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    l = read(spark, d, "lineitem").where((c("l_shipdate") >= day) & (c("l_shipdate") < day + F.expr("INTERVAL 1 DAY")) & (c("l_quantity") > 0) & c("l_returnflag").isin("A", "N", "R"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(exact("l_extendedprice").alias("gross"), F.count(F.lit(1)).alias("trips"), (exact("l_tax") / F.count(F.lit(1))).alias("mean_tax"))


@R.query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS repo, user_id AS actor, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS pushes, count(*) FILTER (WHERE event_type = 'view') AS stars
FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY ALL""")
def ex_event_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where(c("event_type").isin("purchase", "view", "click"))
    return e.groupBy((F.get_json_object("props", "$.k").cast("bigint") % 10).alias("repo"), c("user_id").alias("actor")).agg(F.count(F.lit(1)).alias("events"), F.count_if(c("event_type") == "purchase").alias("pushes"), F.count_if(c("event_type") == "view").alias("stars"))


@R.query("""WITH r AS (SELECT l_partkey, count(*) AS votes, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rating FROM lineitem GROUP BY l_partkey), s AS (SELECT p_size, count(*) AS titles_in_size FROM part GROUP BY p_size)
SELECT p_partkey, p_name, rating, votes, titles_in_size FROM part JOIN r ON l_partkey = p_partkey JOIN s USING (p_size) WHERE votes > 20 AND rating >= 20 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49.5 AND l_returnflag = 'R') ORDER BY rating DESC, votes DESC, p_partkey LIMIT 50""")
def ex_top_titles(spark: SparkSession, d: str) -> DataFrame:
    l, p = read(spark, d, "lineitem"), read(spark, d, "part")
    r = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("votes"), (exact("l_quantity") / F.count(F.lit(1))).alias("rating"), F.max((c("l_quantity") > 49.5) & (c("l_returnflag") == "R")).alias("barred")).where("votes > 20 AND rating >= 20 AND NOT barred")
    sizes = p.groupBy("p_size").agg(F.count(F.lit(1)).alias("titles_in_size"))
    return p.join(r, c("p_partkey") == c("l_partkey")).join(sizes, "p_size").select("p_partkey", "p_name", "rating", "votes", "titles_in_size").orderBy(F.desc("rating"), F.desc("votes"), "p_partkey").limit(50)
