"""File formats, execution control, suites that run, and whole reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis as A, engines as E, reports, rules
from ..operators import suites
from ..session import materialise
from ..sources import catalog, files
from ..sources.tables import read
from .registry import Registry

R = Registry()
c = F.col

for fmt in ("parquet", "orc", "json", "csv"):

    @R.query("SELECT n_nationkey, n_name, n_regionkey FROM nation", name=f"io_{fmt}_round_trip")
    def _(spark: SparkSession, d: str, fmt: str = fmt) -> DataFrame:
        return files.round_trip(read(spark, d, "nation"), fmt)


@R.query("SELECT c_name AS value FROM customer")
def io_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return files.round_trip(read(spark, d, "customer").select(c("c_name").alias("value")), "text")


@R.query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def io_partitioned_pruning(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return files.round_trip(o.repartition("o_orderpriority"), "parquet", ["o_orderpriority"]).where("o_orderpriority = '2-HIGH'")


@R.query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def io_overwrite_then_append(spark: SparkSession, d: str) -> DataFrame:
    n, path = read(spark, d, "nation"), files.fresh_path(spark, "nation")
    files.write(n, path, "parquet")
    files.write(n.where("n_regionkey = 0"), path, "parquet", mode="overwrite")
    files.write(n.where("n_regionkey = 3"), path, "parquet", mode="append")
    return files.read(spark, path, "parquet", n.schema)


@R.query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def exec_repartition_reused(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out by the key once; both aggregations and the join stay where the rows are."""
    l = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey")
    return l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(l.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts")), "l_suppkey")


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def exec_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).coalesce(1)


@R.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def exec_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return materialise(read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "counts").where("n > 12")


@R.query("SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def exec_broadcast_hint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")  # 5 rows at any scale


@R.query("SELECT r_regionkey, r_name, NULL AS note FROM region UNION ALL SELECT n_nationkey + 1000, n_name, 'nation' FROM nation WHERE n_regionkey = 0")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_regionkey = 0").select(F.lit("nation").alias("note"), c("n_name").alias("r_name"), (c("n_nationkey") + 1000).alias("r_regionkey"))
    return read(spark, d, "region").unionByName(n, allowMissingColumns=True)


@R.query("SELECT l_returnflag, l_linestatus, metric, value FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL) UNPIVOT (value FOR metric IN (n, suppliers))")
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))
    return x.unpivot(["l_returnflag", "l_linestatus"], ["n", "suppliers"], "metric", "value")


SUITE = [
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "c_name"}}, {"type": "expect_column_values_to_be_between", "kwargs": {"column": "c_acctbal", "min_value": 0, "mostly": 0.9}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "c_mktsegment", "value_set": ["BUILDING", "MACHINERY"]}}, {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "c_nationkey"}},
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}}, {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "c_name", "regex": "1$"}}, {"expectation_type": "expect_the_unexpected", "kwargs": {"column": "c_name"}},
]


@R.query("""WITH x AS (SELECT 'expect_column_values_to_not_be_null' AS expectation, 'c_name' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE c_name IS NULL) AS n_failing, 1.0 AS m FROM customer
UNION ALL SELECT 'expect_column_values_to_be_between', 'c_acctbal', count(*), count(*) FILTER (WHERE c_acctbal < 0), 0.9 FROM customer UNION ALL SELECT 'expect_column_values_to_be_in_set', 'c_mktsegment', count(*), count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), 1.0 FROM customer
UNION ALL SELECT 'expect_column_values_to_be_unique', 'c_nationkey', count(*), count(*) - count(DISTINCT c_nationkey), 1.0 FROM customer UNION ALL SELECT 'expect_table_row_count_to_be_between', NULL, count(*), 0, 1.0 FROM customer
UNION ALL SELECT 'expect_column_values_to_match_regex', 'c_name', count(*), count(*) FILTER (WHERE NOT regexp_matches(c_name, '1$')), 1.0 FROM customer UNION ALL SELECT 'expect_the_unexpected', 'c_name', NULL, NULL, 1.0)
SELECT expectation, "column", n_rows, n_failing, (n_rows - n_failing) / n_rows >= m AS success FROM x""")
def dq_run_suite(spark: SparkSession, d: str) -> DataFrame:
    return suites.run_suite(read(spark, d, "customer"), SUITE)


# ---- reports


#: 20 x 0.25 + 93 x 0.25 + 90 x 0.20 + 96 x 0.15 + 91 x 0.15 = 74.3
@R.query(A.expected("pipeline, format, critical, warning, info, total", [("shop_mart", "sql", 3, 4, 3, 74)]))
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    t = A.tables_of(spark, ["shop_mart"])
    params = spark.createDataFrame([(10_000_000, 24, "snowflake")], "n_rows long, runs long, warehouse string")
    x = reports.report(t, materialise(rules.run(t), "issues"), params)
    return x.select("pipeline", "format", *[c(k).cast("int").alias(k) for k in ("critical", "warning", "info", "total")])


@R.query(None)
def report_what_if(spark: SparkSession, d: str) -> DataFrame:
    t = A.tables_of(spark, ["shop_mart", "messy_sql"])
    rules.load()
    ids = [r.id for r in rules.RULES if r.id in E.MULTIPLIERS]
    return reports.what_if(t, materialise(rules.run(t, ids), "issues"), A.params(spark))


GROUNDED = [("p", "lake.sales.orders"), ("p", "customer"), ("p", "x.unknown"), ("q", "Nation")]


@R.query(f"""WITH g(pipeline, name) AS (VALUES {A.values(GROUNDED)}), k AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns GROUP BY table_name)
SELECT g.pipeline, g.name, k.table_name, k.columns FROM g LEFT JOIN k ON k.table_name = string_split(lower(g.name), '.')[-1]""")
def ground_tables(spark: SparkSession, d: str) -> DataFrame:
    x = reports.ground(spark.createDataFrame(GROUNDED, "pipeline string, name string"), catalog.columns(spark, d))
    return x.withColumn("columns", F.array_join("columns", ","))


@R.query(f"""WITH {A.D}, s AS (SELECT DISTINCT pipeline, '  ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') || '["' || source || '"] --> ' || regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g') || '["' || target || '"]' AS line FROM d)
SELECT pipeline, 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS graph FROM s GROUP BY pipeline""")
def lineage_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return E.mermaid(A.deps(spark))


PII = [("p1", "a", "email"), ("p1", "a", "phone"), ("p1", "b", "ssn"), ("p2", "a", "email"), ("p4", "z", "dob")]
FLOWS = [("p1", "a", "email", "o", "e", ""), ("p1", "a", "phone", "o", "p", ""), ("p1", "b", "ssn", "o", "s", ""), ("p2", "a", "email", "o", "e", "sha2(email, 256)"), ("p3", "a", "x", "o", "x", "")]
SECRETS = [("p3", "a key")]


@R.query(f"""WITH p(pipeline) AS (VALUES ('p1'), ('p2'), ('p3'), ('p4'), ('p5')), i(pipeline, name, col) AS (VALUES {A.values(PII)}), f(pipeline, st, sc, ot, oc, ex) AS (VALUES {A.values(FLOWS)}), s(pipeline, what) AS (VALUES {A.values(SECRETS)}),
x AS (SELECT pipeline, (SELECT count(DISTINCT (st, sc)) FROM f JOIN i ON i.pipeline = f.pipeline AND i.name = st AND i.col = sc WHERE f.pipeline = p.pipeline AND NOT regexp_matches(ex, '(?i)\\b(hash|sha\\d|md5|mask)')) AS open,
(SELECT count(*) FROM s WHERE s.pipeline = p.pipeline) AS secrets, (SELECT count(*) FROM i WHERE i.pipeline = p.pipeline) AS pii FROM p)
SELECT *, CASE WHEN secrets > 0 OR open >= 3 THEN 'HIGH' WHEN pii > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def security_risk(spark: SparkSession, d: str) -> DataFrame:
    pii = spark.createDataFrame(PII, "pipeline string, name string, column string")
    flows = spark.createDataFrame(FLOWS, "pipeline string, source_table string, source_column string, output_table string, output_column string, expression string")
    return E.security_risk(flows, spark.createDataFrame(SECRETS, "pipeline string, what string"), pii, spark.createDataFrame([(f"p{k}",) for k in range(1, 6)], "pipeline string"))
