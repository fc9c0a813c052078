"""Queries over the representation, the issues and the engines, on small pipelines that are written here."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detect, engines as E, ir, rules, rules_demo
from .pipelines_demo import OPERATION_TEXTS, TEXTS
from .registry import Registry

R = Registry()
c = F.col


def values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def tables_of(spark: SparkSession, names: list[str] | None = None) -> ir.Tables:
    texts = {k: v for k, v in TEXTS.items() if names is None or k in names}
    return ir.analyse(ir.from_texts(spark, texts))


def of_formats(spark: SparkSession, *formats: str) -> ir.Tables:
    frame = ir.from_texts(spark, TEXTS)
    return ir.analyse(frame.where(detect.format_of(c("source")).isin(*formats)))


# ---- detection

#: Written out by reading the texts.
DETECTED = [
    ("clean_report", "sql", "snowflake"), ("consumer", "kafka", None), ("fct_sales", "dbt", "snowflake"), ("flow", "prefect", None), ("garbage", None, None),
    ("leaky_job", "spark", None), ("messy_sql", "sql", "snowflake"), ("nightly_dag", "airflow", None), ("page_views", "flink", "flink"), ("shop_mart", "sql", "snowflake"),
    ("stream_job", "spark", None), ("suite", "great_expectations", None), ("topology", "kafka", None),
]


@R.query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in DETECTED) + ") AS v(pipeline, format, dialect)")
def detect_format(spark: SparkSession, d: str) -> DataFrame:
    x = ir.from_texts(spark, TEXTS).withColumn("format", detect.format_of(c("source")))
    return x.select("pipeline", "format", detect.dialect_of(c("format"), c("source")).alias("dialect"))


# ---- what the parsers and rules find; SQL can't parse, so the expected rows are written out


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy("pipeline", *by).agg(F.count(F.lit(1)).alias("n"))


def expected(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {values(rows)}) AS v({columns})"


#: The operations of each text: what the engine gave, compared with the text by reading; a filter on a partition column counts as both kinds.
OPERATIONS = {
    "clean_report": "SELECT 1, JOIN 1, FILTER 1, PARTITION_FILTER 1, AGGREGATE 1, LIMIT 1",
    "consumer": "SOURCE 1, SINK 1",
    "fct_sales": "SELECT 1, JOIN 1, FILTER 1",
    "flow": "DAG 1, TASK 2",
    "leaky_job": "READ 1, REPARTITION 1, WRITE 1",
    "messy_sql": "CTE 2, SELECT 5, DISTINCT 1, JOIN 2, FILTER 2, PARTITION_FILTER 1, UNION 1, ORDER_BY 1, DELETE 1, UPDATE 1, INSERT 1, AGGREGATE 1, WINDOW 1",
    "nightly_dag": "DAG 1, SENSOR 1, TASK 3, XCOM 1",
    "operations_job": "READ 3, BROADCAST 1, JOIN 2, GROUP_BY 1, AGGREGATE 1, WINDOW 1, REPARTITION 1, CACHE 1, COLLECT 1, WRITE 1",
    "operations_loop": "DAG 1, TASK 1, DYNAMIC_DAG 1",
    "operations_merge": "MERGE 1",
    "page_views": "SOURCE 1, SINK 1, INSERT 1, SELECT 1, WINDOW 1, AGGREGATE 1, ORDER_BY 1",
    "shop_mart": "SELECT 3, SUBQUERY 2, JOIN 1, FILTER 2, AGGREGATE 1",
    "stream_job": "READ 1, WATERMARK 1, GROUP_BY 1, CHECKPOINT 1, WRITE 1",
    "suite": "EXPECTATION 2",
    "topology": "SOURCE 1, GROUP_BY 1, WINDOW 1, STATE 1, SINK 1",
}
OPERATION_ROWS = [(p, *kind.split()) for p, kinds in OPERATIONS.items() for kind in kinds.split(", ")]


@R.query(f"SELECT pipeline, type, CAST(n AS BIGINT) AS n FROM ({expected('pipeline, type, n', OPERATION_ROWS)})")
def ir_operation_mix(spark: SparkSession, d: str) -> DataFrame:
    return counted(ir.analyse(ir.from_texts(spark, TEXTS | OPERATION_TEXTS)).ops(), "type")


#: Tables with the columns that the text names of them, sorted: what the engine gave, compared with the texts by reading.
TABLE_ROWS = [
    ("clean_report", "sales.invoice_lines", "read", "s", "event_date,net_value,region_id"), ("clean_report", "sales.regions", "read", "r", "region_id,region_name"),
    ("consumer", "orders", "read", "", ""), ("consumer", "invoices", "write", "", ""),
    ("fct_sales", "till.sales", "read", "s", "client_id,net_value,sale_id,sold_at,state"), ("fct_sales", "stg_clients", "read", "c", "client_id"), ("fct_sales", "fct_sales", "write", "", "net_value,sale_id"),
    ("leaky_job", "s3://open-data-public/rates.csv", "read", "", ""), ("leaky_job", "s3://own/rates", "write", "", ""),
    ("messy_sql", "pay.transactions", "read", "", "amount,created_at,id"), ("messy_sql", "pay.archive", "read", "", "amount,id"), ("messy_sql", "pay.accounts", "readwrite", "acc", "account_key,balance"),
    ("messy_sql", "pay.scratch", "write", "", ""), ("messy_sql", "pay.totals", "write", "", ""),
    ("page_views", "views", "read", "", "n,page,seen_at,visitor"), ("page_views", "views_by_page", "write", "", "bucket,n,page"),
    ("shop_mart", "shop.basket_mart", "write", "", ""), ("shop_mart", "shop.basket_lines", "read", "bl", "basket_id"), ("shop_mart", "shop.baskets", "read", "b", "opened_on,shopper_id"),
    ("shop_mart", "shop.shoppers", "read", "u", "customer_email"), ("shop_mart", "shop.ghosts", "read", "g", "shopper_id"),
    ("stream_job", "taps", "read", "", ""), ("stream_job", "s3://own/counts", "write", "", ""),
    ("suite", "sales", "read", "", "net_value,sale_id"), ("topology", "clicks", "read", "", ""), ("topology", "click_counts", "write", "", ""),
]


@R.query(expected("pipeline, name, access, alias, columns", TABLE_ROWS))
def ir_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables_of(spark).tables.select("pipeline", "name", "access", "alias", F.array_join(F.array_sort("columns"), ",").alias("columns"))


LINEAGE_ROWS = [
    ("clean_report", "query_result", "region_name", "sales.regions", "region_name", "direct", ""), ("clean_report", "query_result", "net_value", "sales.invoice_lines", "net_value", "aggregation", "SUM(s.net_value)"),
    ("fct_sales", "fct_sales", "sale_id", "till.sales", "sale_id", "direct", ""), ("fct_sales", "fct_sales", "sold_at", "till.sales", "sold_at", "direct", ""),
    ("fct_sales", "fct_sales", "client_id", "stg_clients", "client_id", "direct", ""), ("fct_sales", "fct_sales", "net_value", "till.sales", "net_value", "direct", ""),
    ("page_views", "views_by_page", "TUMBLE_START(seen_at, INTERVAL '3' HOUR)", "views", "seen_at", "expression", "TUMBLE_START(seen_at, INTERVAL '3' HOUR)"), ("page_views", "views_by_page", "page", "views", "page", "direct", ""),
    ("shop_mart", "shop.basket_mart", "customer_email", "shop.shoppers", "customer_email", "direct", ""),
]


@R.query(expected("pipeline, output_table, output_column, source_table, source_column, transformation, expression", LINEAGE_ROWS))
def ir_column_lineage(spark: SparkSession, d: str) -> DataFrame:
    return tables_of(spark).lineage.select("pipeline", "output_table", "output_column", "source_table", "source_column", "transformation", "expression")


def fire(spark: SparkSession, cases: dict[str, tuple[str, str]]) -> DataFrame:
    """Each rule on a text that it is for, and on a near miss."""
    texts = {f"{rule}/{kind}": text for rule, pair in cases.items() for kind, text in zip(("fires", "near_miss"), pair, strict=True)}
    issues = rules.run(ir.analyse(ir.from_texts(spark, texts)), list(cases))
    issues = issues.where(F.substring_index("pipeline", "/", 1) == c("rule")).select("rule", F.substring_index("pipeline", "/", -1).alias("kind")).distinct()
    every = spark.createDataFrame([(r,) for r in cases], "rule string")
    hit = lambda kind: F.coalesce(F.bool_or(c("kind") == kind), F.lit(False)).alias(kind)
    return every.join(issues, "rule", "left").groupBy("rule").agg(hit("fires"), hit("near_miss"))


for _name, _cases in rules_demo.CASES.items():
    R.query(expected("rule, fires, near_miss", [(r, True, False) for r in _cases]), name=f"rules_fire_{_name}")(lambda spark, d, cases=_cases: fire(spark, cases))


def found(spark: SparkSession, module: str, *formats: str) -> DataFrame:
    rules.load()
    ids = [r.id for r in rules.RULES if r.find.__module__.endswith(f".{module}")]
    t = of_formats(spark, *formats)
    return counted(rules.run(t, ids), "rule", "severity").withColumn("n", c("n").cast("int"))


SQL_EXPECTED = [
    ("shop_mart", "ANTI_PATTERN_NOT_IN_NULL", "WARNING", 1), ("shop_mart", "CARTESIAN_JOIN", "CRITICAL", 1), ("shop_mart", "HARDCODED_DATE", "INFO", 1), ("shop_mart", "LEADING_WILDCARD_LIKE", "WARNING", 1),
    ("shop_mart", "MISSING_COLUMN_ALIAS", "INFO", 1), ("shop_mart", "MISSING_PARTITION_FILTER", "WARNING", 1), ("shop_mart", "NESTED_LOOP_RISK", "CRITICAL", 1), ("shop_mart", "SELECT_STAR", "CRITICAL", 1),
]


@R.query(expected("pipeline, rule, severity, n", SQL_EXPECTED))
def issues_sql(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "sql", "sql").where("pipeline = 'shop_mart'")


MESSY = {"CASE_WITHOUT_ELSE": "INFO", "DELETE_WITHOUT_WHERE": "CRITICAL", "DISTINCT_STAR": "WARNING", "EXPLODING_JOIN": "WARNING", "FUNCTION_ON_FILTER_COLUMN": "WARNING", "GROUP_BY_ORDINAL": "INFO", "HARDCODED_DATE": "INFO", "HAVING_WITHOUT_AGGREGATE": "WARNING", "IMPLICIT_CAST_IN_JOIN": "CRITICAL", "IMPLICIT_COLUMN_INSERT": "WARNING", "INCONSISTENT_CASE_CONVENTION": "INFO", "LIKE_WITHOUT_WILDCARD": "INFO", "MISSING_COLUMN_ALIAS": "INFO", "NULL_COMPARISON": "WARNING", "ORDER_BY_WITHOUT_LIMIT": "WARNING", "OR_IN_WHERE_DEFEATS_INDEX": "WARNING", "SELECT_STAR": "CRITICAL", "UNBOUNDED_FULL_SCAN": "CRITICAL", "UNION_INSTEAD_OF_UNION_ALL": "WARNING", "UNUSED_CTE": "INFO", "UPDATE_WITHOUT_WHERE": "CRITICAL", "WINDOW_FUNCTION_ON_FULL_TABLE": "WARNING"}
SQL_ALL_EXPECTED = SQL_EXPECTED + [("messy_sql", r, s, 2 if r == "MISSING_COLUMN_ALIAS" else 1) for r, s in MESSY.items()] + [("clean_report", "HARDCODED_DATE", "INFO", 1), ("page_views", "MISSING_COLUMN_ALIAS", "INFO", 1), ("fct_sales", "MISSING_PARTITION_FILTER", "WARNING", 1)]


@R.query(expected("pipeline, rule, severity, n", SQL_ALL_EXPECTED))
def issues_sql_all(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "sql", "sql", "flink", "dbt")


ORCHESTRATION_EXPECTED = [("nightly_dag", r, s, n) for r, s, n in [("MISSING_OWNER", "WARNING", 1), ("NO_CATCHUP_SET", "CRITICAL", 1), ("NO_DAGRUN_TIMEOUT", "WARNING", 1), ("NO_DAG_TAGS", "INFO", 1), ("NO_DOC_MD", "INFO", 1), ("NO_EXECUTION_TIMEOUT", "WARNING", 2), ("NO_MAX_ACTIVE_RUNS", "WARNING", 1), ("NO_ON_FAILURE_CALLBACK", "WARNING", 1), ("NO_POOL_SET", "WARNING", 2), ("NO_RETRIES", "CRITICAL", 1), ("NO_SLA", "WARNING", 1), ("SENSOR_POKE_MODE", "WARNING", 1), ("SEQUENTIAL_HEAVY_TASKS", "CRITICAL", 1), ("XCOMS_LARGE_DATA", "CRITICAL", 1)]]


FLOW_EXPECTED = [("flow", r, s, 1) for r, s in [("MANUAL_ONLY_SCHEDULE", "INFO"), ("MISSING_OWNER", "WARNING"), ("NO_DAG_TAGS", "INFO"), ("NO_EXECUTION_TIMEOUT", "WARNING"), ("NO_ON_FAILURE_CALLBACK", "WARNING"), ("NO_RETRIES", "CRITICAL")]]


@R.query(expected("pipeline, rule, severity, n", ORCHESTRATION_EXPECTED + FLOW_EXPECTED))
def issues_orchestration(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "orchestration", "airflow", "prefect")


DBT_EXPECTED = [("fct_sales", r, s, 1) for r, s in [("MISSING_DESCRIPTION", "WARNING"), ("MISSING_INCREMENTAL_GUARD", "WARNING"), ("MISSING_INCREMENTAL_STRATEGY", "WARNING"), ("MISSING_NOT_NULL_TEST", "WARNING"), ("MISSING_SOURCE_FRESHNESS", "INFO"), ("MISSING_UNIQUE_TEST", "WARNING"), ("NO_TAGS", "INFO"), ("NO_TESTS_ON_PRIMARY_KEY", "CRITICAL"), ("NO_UNIQUE_KEY_ON_INCREMENTAL", "WARNING"), ("UNTESTED_SOURCE", "CRITICAL")]]


@R.query(expected("pipeline, rule, severity, n", DBT_EXPECTED))
def issues_dbt(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "transform", "dbt")


STREAM_EXPECTED = [("page_views", r, s, 1) for r, s in [("BLOCKING_OPERATION", "WARNING"), ("MISSING_WATERMARK", "CRITICAL"), ("NO_BACKPRESSURE_HANDLING", "WARNING"), ("NO_CHECKPOINTING", "CRITICAL"), ("NO_CONSUMER_GROUP_NAMING", "INFO"), ("WIDE_TUMBLING_WINDOW", "WARNING")]]


@R.query(expected("pipeline, rule, severity, n", STREAM_EXPECTED))
def issues_streaming(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "streaming", "flink").where("pipeline = 'page_views'")


STREAM_ALL_EXPECTED = [("consumer", "NO_BACKPRESSURE_HANDLING", "WARNING", 1), ("consumer", "NO_CHECKPOINTING", "CRITICAL", 1), ("leaky_job", "SINGLE_PARTITION_SINK", "WARNING", 1)] + [("topology", r, s, 1) for r, s in [("MISSING_WATERMARK", "CRITICAL"), ("NO_BACKPRESSURE_HANDLING", "WARNING"), ("NO_CHECKPOINTING", "CRITICAL"), ("NO_CONSUMER_GROUP_NAMING", "INFO"), ("UNBOUNDED_STATE", "CRITICAL"), ("WIDE_TUMBLING_WINDOW", "WARNING")]]


@R.query(expected("pipeline, rule, severity, n", STREAM_ALL_EXPECTED))
def issues_streaming_all(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "streaming", "spark", "kafka")


SECURITY_EXPECTED = [("leaky_job", "HARDCODED_CREDENTIALS", "CRITICAL", 1), ("leaky_job", "PUBLIC_CLOUD_PATH", "WARNING", 1), ("shop_mart", "PII_COLUMN_NAMED", "INFO", 1), ("shop_mart", "UNMASKED_PII_TO_OUTPUT", "WARNING", 1)]


@R.query(expected("pipeline, rule, severity, n", SECURITY_EXPECTED))
def issues_security(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, "security", "sql", "spark", "dbt", "flink", "airflow", "prefect", "kafka", "great_expectations")




# ---- engines, over tables that both sides spell out

DEPS = [(p, k, s, t, y) for k, (p, s, t, y) in enumerate([("p1", "raw.orders", "stg.orders", "reads_from"), ("p1", "raw.customers", "stg.customers", "reads_from"), ("p1", "stg.orders", "mart.sales", "reads_from"), ("p1", "stg.customers", "mart.sales", "depends_on"), ("p1", "stg.customers", "mart.sales", "reads_from"), ("p1", "mart.sales", "mart.report", "writes_to"), ("p1", "raw orders", "stg-orders", "reads_from"), ("p2", "a", "b", "triggers"), ("p2", "b", "c", "triggers"), ("p2", "c", "d", "triggers"), ("p2", "b", "e", "triggers"), ("p2", "x", "y", "triggers"), ("p2", "y", "z", "triggers"), ("p3", "m", "n", "triggers"), ("p3", "n", "o", "triggers"), ("p3", "o", "p", "triggers")])]
TABLES = [(p, k, n, a, cols) for k, (p, n, a, cols) in enumerate([("p1", "raw.orders", "read", "id,amount"), ("p1", "raw.customers", "read", "id,email"), ("p1", "stg.orders", "write", "id,amount"), ("p1", "stg.orders", "read", "id,extra"), ("p1", "mart.sales", "write", "id,total,order_status,customer_id"), ("p1", "mart.report", "write", "total,created_at")])]
LINEAGE = [(p, k, ot, oc, st, sc, tr, "") for k, (p, ot, oc, st, sc, tr) in enumerate([("p1", "mart.sales", "total", "stg.orders", "amount", "aggregation"), ("p1", "mart.sales", "id", "stg.orders", "id", "direct"), ("p1", "mart.sales", "customer_id", "stg.customers", "id", "direct"), ("p1", "mart.report", "total", "mart.sales", "total", "window"), ("p1", "mart.report", "x", "mart.sales", "id", "expression"), ("p1", "mart.report", "y", "mart.sales", "id", "expression")])]
FORMATS = [("p1", "sql"), ("p2", "airflow"), ("p3", "airflow"), ("p4", "sql")]
ISSUES = [(p, k, r, s, cat, "fix " + r) for k, (p, r, s, cat) in enumerate([("p1", "SELECT_STAR", "CRITICAL", "performance"), ("p1", "SELECT_STAR", "CRITICAL", "performance"), ("p1", "CARTESIAN_JOIN", "CRITICAL", "performance"), ("p1", "MISSING_PARTITION_FILTER", "WARNING", "cost"), ("p1", "UNOPTIMIZED_CTE_REUSE", "WARNING", "performance"), ("p1", "UNOPTIMIZED_CTE_REUSE", "WARNING", "performance"), ("p1", "HARDCODED_CREDENTIALS", "CRITICAL", "security"), ("p2", "NO_RETRIES", "CRITICAL", "reliability"), ("p2", "NO_SLA", "WARNING", "observability"), ("p2", "SENSOR_POKE_MODE", "WARNING", "performance"), ("p2", "MISSING_OWNER", "WARNING", "maintainability"), ("p2", "NO_DAG_TAGS", "INFO", "maintainability"), ("p3", "MISSING_WATERMARK", "CRITICAL", "reliability"), ("p3", "GRANT_BROAD_ACCESS", "WARNING", "security"), ("p3", "CASE_WITHOUT_ELSE", "INFO", "reliability")])]
SHAPES = [("p1", 3, True, 0), ("p2", 1, False, 2), ("p3", 20, False, 10), ("p4", 0, False, 0)]
PARAMS = [(10_000_000, 24, "snowflake"), (500_000_000, 2, "bigquery"), (1000, 24, "redshift"), (10**15, 10**6, "databricks"), (0, 24, "snowflake")]
TRAITS = [("p1", True, False, 0, True, True), ("p2", False, False, 3, False, False), ("p3", False, True, 1, False, True), ("p4", False, False, 0, True, True)]


def deps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPS, "pipeline string, ord int, source string, target string, type string")


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLES, "pipeline string, ord int, name string, access string, cols string").withColumn("columns", F.split("cols", ","))


def lineage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINEAGE, "pipeline string, ord int, output_table string, output_column string, source_table string, source_column string, transformation string, expression string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "pipeline string, format string")


def issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISSUES, "pipeline string, ord int, rule string, severity string, category string, fix string")


def params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMS, "n_rows long, runs long, warehouse string")


def traits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRAITS, "pipeline string, has_tests boolean, has_sla boolean, retries int, described boolean, has_aliases boolean")


D = f"d(pipeline, ord, source, target, type) AS (VALUES {values(DEPS)})"
T = f"t(pipeline, ord, name, access, cols) AS (VALUES {values(TABLES)})"
L = f"l(pipeline, ord, output_table, output_column, source_table, source_column, transformation, expression) AS (VALUES {values(LINEAGE)})"
FM = f"f(pipeline, format) AS (VALUES {values(FORMATS)})"
I = f"i(pipeline, ord, rule, severity, category, fix) AS (VALUES {values(ISSUES)})"  # noqa: E741
P = f"p(n_rows, runs, warehouse) AS (SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), c FROM (VALUES {values(PARAMS)}) AS q(a, b, c))"
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"
POINTS = "CASE severity WHEN 'CRITICAL' THEN 22 WHEN 'WARNING' THEN 7 ELSE 2 END"


@R.query(f"""WITH {D}, {T}, {L}, {FM}, m AS (SELECT pipeline, name, CASE WHEN count(DISTINCT access) = 1 THEN max(access) ELSE 'readwrite' END AS access FROM t GROUP BY ALL),
o AS (SELECT DISTINCT pipeline, source AS name FROM d UNION SELECT pipeline, source_table FROM l),
k AS (SELECT m.pipeline, m.name AS node, CASE access WHEN 'read' THEN 'source' WHEN 'readwrite' THEN 'model' ELSE CASE WHEN o.name IS NULL THEN 'output' ELSE 'model' END END AS kind FROM m LEFT JOIN o USING (pipeline, name)),
e AS (SELECT pipeline, source AS node FROM d UNION SELECT pipeline, target FROM d UNION SELECT pipeline, source_table FROM l UNION SELECT pipeline, output_table FROM l),
x AS (SELECT e.pipeline, e.node, CASE WHEN f.format = 'airflow' THEN 'task' WHEN regexp_matches(lower(e.node), '(^|[^a-z0-9])(raw|source|src|stg|staging|landing|bronze|ingest)([^a-z0-9]|$)') THEN 'source' ELSE 'table' END AS kind
FROM e LEFT JOIN f USING (pipeline) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pipeline = e.pipeline AND k.node = e.node)), u AS (SELECT * FROM k UNION ALL SELECT * FROM x)
SELECT * FROM u UNION ALL SELECT pipeline, 'pipeline', 'table' FROM f WHERE pipeline NOT IN (SELECT pipeline FROM u)""")
def lineage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return E.lineage_nodes(tables(spark), deps(spark), lineage(spark), formats(spark)).drop("columns")


SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@R.query(f"""WITH {D}, {L}, x AS (SELECT pipeline, source, target, arg_min(type, ord) AS type, min(ord) AS ord FROM d GROUP BY ALL),
n AS (SELECT pipeline, source_table AS source, output_table AS target, transformation, count(DISTINCT (source_column, output_column)) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pipeline, source, target ORDER BY transformation = 'direct', n DESC, CASE transformation WHEN 'aggregation' THEN 0 WHEN 'window' THEN 1 ELSE 2 END) AS k, sum(n) OVER (PARTITION BY pipeline, source, target) AS all_n FROM n),
y AS (SELECT * FROM x FULL JOIN (SELECT pipeline, source, target, transformation, all_n FROM r WHERE k = 1) USING (pipeline, source, target)),
z AS (SELECT *, 'e-' || {SLUG.format("source")} || '-' || {SLUG.format("target")} AS base FROM y), w AS (SELECT *, row_number() OVER (PARTITION BY pipeline, base ORDER BY ord NULLS LAST, source, target) AS k FROM z)
SELECT pipeline, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS edge_id, source, target, coalesce(type, 'reads_from') AS type, CAST(coalesce(all_n, 0) AS INTEGER) AS n_links, coalesce(transformation, 'unknown') AS transformation FROM w""")
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.lineage_edges(deps(spark), lineage(spark)).drop("links")


@R.query(f"""WITH RECURSIVE {D}, n AS (SELECT pipeline, source AS node FROM d UNION SELECT pipeline, target FROM d),
w(pipeline, node, depth) AS (SELECT pipeline, node, 0 FROM n UNION SELECT d.pipeline, d.target, w.depth + 1 FROM w JOIN d ON d.pipeline = w.pipeline AND d.source = w.node WHERE w.depth < 20)
SELECT pipeline, node, max(depth) AS depth FROM w GROUP BY ALL""")
def lineage_depth(spark: SparkSession, d: str) -> DataFrame:
    edges = deps(spark)
    return E.depths(edges.select("pipeline", F.explode(F.array("source", "target")).alias("node")), edges)


@R.query(f"""WITH RECURSIVE {D}, e AS (SELECT DISTINCT pipeline, source, target FROM d WHERE type = 'triggers'),
k AS (SELECT e.* FROM e WHERE (SELECT count(*) FROM e x WHERE x.pipeline = e.pipeline AND x.source = e.source) = 1 AND (SELECT count(*) FROM e x WHERE x.pipeline = e.pipeline AND x.target = e.target) = 1),
w(pipeline, task, chain, position) AS (SELECT DISTINCT pipeline, source, source, 0 FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.pipeline = k.pipeline AND x.target = k.source)
UNION ALL SELECT k.pipeline, k.target, w.chain, w.position + 1 FROM w JOIN k ON k.pipeline = w.pipeline AND k.source = w.task) SELECT * FROM w""")
def dag_linear_chains(spark: SparkSession, d: str) -> DataFrame:
    from .rules.orchestration import linear_chains

    return linear_chains(deps(spark).where("type = 'triggers'"))


_M = " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.MULTIPLIERS.items())
_PRICE = "CASE WHEN {b} <= 0 THEN 0.0 WHEN warehouse = 'snowflake' THEN {b} / 80e9 * 3.0 WHEN warehouse = 'bigquery' THEN floor(greatest({b}, 10485760.0)) / 1099511627776 * 6.25 WHEN warehouse = 'redshift' THEN (15 + {b} / 300e6) / 3600 * 3.26 * 0.25 ELSE (60 + {b} / 400e6) / 3600 * 4 * 0.55 END"


@R.query(f"""WITH {I}, {P}, s(pipeline, n_reads, has_star, n_projected) AS (VALUES {values(SHAPES)}),
r AS (SELECT pipeline, rule, CASE rule WHEN 'UNOPTIMIZED_CTE_REUSE' THEN pow(1.5, least(count(*), 4)) ELSE CAST(CASE rule {_M} ELSE 1.0 END AS DOUBLE) END AS m FROM i GROUP BY pipeline, rule),
g AS (SELECT r.pipeline, p.warehouse AS gw, exp(sum(ln(CASE WHEN p.warehouse = 'bigquery' AND rule = 'MISSING_PARTITION_FILTER' THEN 4.0 ELSE greatest(1.0, m) END))) AS k FROM r CROSS JOIN (SELECT DISTINCT warehouse FROM p) p GROUP BY ALL),
x AS (SELECT s.pipeline, CAST(least(n_rows, 10000000000000) AS DOUBLE) AS n_rows, CAST(least(runs, 100000) AS DOUBLE) AS runs, warehouse, CASE WHEN has_star OR n_projected = 0 THEN 1.0 ELSE least(greatest(n_projected / 20, 0.15), 1.0) END AS width, least(greatest(n_reads, 1), 16) AS scans,
least(coalesce(g.k, 1.0), 500.0) AS multiplier FROM s CROSS JOIN p LEFT JOIN g ON g.pipeline = s.pipeline AND gw = warehouse),
y AS (SELECT *, n_rows * 200 * width * scans AS b0, n_rows * 200 * width * scans * multiplier AS b1 FROM x),
z AS (SELECT *, {_PRICE.format(b="b1")} AS usd1, {_PRICE.format(b="b0")} AS usd0 FROM y)
SELECT pipeline, n_rows, runs, warehouse, round(multiplier, 6) AS multiplier, round(usd1 * runs * 30, 2) AS usd_month, round(least(usd0, usd1) * runs * 30, 2) AS usd_month_optimised,
CASE WHEN usd1 * runs * 30 > 500 THEN 'HIGH' WHEN usd1 * runs * 30 > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM z""")
def cost_grid(spark: SparkSession, d: str) -> DataFrame:
    shapes = spark.createDataFrame(SHAPES, "pipeline string, n_reads int, has_star boolean, n_projected int")
    x = E.cost(shapes, issues(spark), params(spark))
    return x.select("pipeline", "n_rows", "runs", "warehouse", F.round("multiplier", 6).alias("multiplier"), F.round("usd_month", 2).alias("usd_month"), F.round("usd_month_optimised", 2).alias("usd_month_optimised"), "risk")


@R.query(f"""WITH {I}, {P}, x AS (SELECT DISTINCT pipeline, rule, severity, category, n_rows, runs, warehouse, CAST(n_rows AS DOUBLE) AS r, CAST(runs AS DOUBLE) AS d, warehouse AS w FROM i CROSS JOIN p)
SELECT pipeline, n_rows, runs, warehouse, rule, round({E.impact_sql(0)}, 6) AS latency, round({E.impact_sql(1)}, 6) AS cost, round({E.impact_sql(2)}, 6) AS failure, round(54.0 * ({E.impact_sql(1)} - 1), 2) AS usd FROM x""")
def impact_grid(spark: SparkSession, d: str) -> DataFrame:
    x = E.impact(issues(spark).drop("ord", "fix").distinct(), params(spark), F.lit(54.0))
    return x.select("pipeline", "n_rows", "runs", "warehouse", "rule", *[F.round(k, 6).alias(k) for k in ("latency", "cost", "failure")], F.round("usd", 2).alias("usd"))


def _minus(dim: str) -> str:
    where = "category IN ('performance', 'cost')" if dim == "efficiency" else f"category = '{dim}'"
    return f"greatest(0, 100 - coalesce((SELECT sum({POINTS}) FROM i WHERE i.pipeline = t.pipeline AND {where}), 0))"


@R.query(f"""WITH {I}, t(pipeline, has_tests, has_sla, retries, described, has_aliases) AS (VALUES {values(TRAITS)}),
x AS (SELECT pipeline, {_minus("efficiency")} AS efficiency, least(100, {_minus("reliability")} + CASE WHEN retries >= 2 THEN 5 ELSE 0 END) AS reliability,
least(100, greatest(0, {_minus("observability")} + CASE WHEN has_tests OR has_sla THEN 10 ELSE -10 END)) AS observability,
least(100, greatest(0, {_minus("maintainability")} + CASE WHEN described THEN 5 WHEN NOT has_aliases THEN -5 ELSE 0 END)) AS maintainability,
CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.pipeline = t.pipeline AND category = 'security' AND severity = 'CRITICAL') THEN least(25, {_minus("security")}) ELSE {_minus("security")} END AS security FROM t)
SELECT pipeline, CAST(efficiency AS INTEGER) AS efficiency, CAST(reliability AS INTEGER) AS reliability, CAST(observability AS INTEGER) AS observability, CAST(maintainability AS INTEGER) AS maintainability, CAST(security AS INTEGER) AS security,
CAST(round_even(round(0.25 * efficiency + 0.25 * reliability + 0.2 * observability + 0.15 * maintainability + 0.15 * security, 9), 0) AS INTEGER) AS total FROM x""")
def score_dims(spark: SparkSession, d: str) -> DataFrame:
    return E.score(traits(spark), issues(spark))


@R.query(f"""WITH {I}, g AS (SELECT *, round({POINTS} * CASE WHEN category IN ('performance', 'cost', 'reliability') THEN 0.25 WHEN category = 'observability' THEN 0.2 ELSE 0.15 END, 1) AS gain FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY gain DESC, {RANK}, rule, ord) AS place FROM g) SELECT pipeline, CAST(place AS INTEGER) AS place, rule, severity, CAST(gain AS DOUBLE) AS gain FROM r WHERE place <= 5""")
def score_roadmap(spark: SparkSession, d: str) -> DataFrame:
    return E.roadmap(issues(spark))


@R.query(f"""WITH {I}, f AS (SELECT pipeline, rule, min({RANK}) AS k, min(ord) AS o, arg_min(fix, ord) AS fix FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY k, o, rule) AS place FROM f)
SELECT pipeline, CAST(place AS INTEGER) AS place, rule, fix FROM r WHERE place <= 5""")
def optimizations_top5(spark: SparkSession, d: str) -> DataFrame:
    return E.optimisations(issues(spark))


BEFORE, AFTER = [("p1", 41, 540.0, 12.5), ("p2", 70, 0.0, 3.0)], [("p1", 80, 54.0, 2.5), ("p2", 75, 0.0, 3.0)]


@R.query(f"""WITH b(pipeline, s, u, i) AS (VALUES {values(BEFORE)}), a(pipeline, s, u, i) AS (VALUES {values(AFTER)})
SELECT pipeline, b.s AS score_before, a.s AS score_after, CAST(b.u - a.u AS DOUBLE) AS usd_saved_month, CAST((b.u - a.u) * 12 AS DOUBLE) AS usd_saved_year, CAST(CASE WHEN b.u > 0 THEN (b.u - a.u) / b.u * 100 ELSE 0 END AS DOUBLE) AS savings_pct, CAST(b.i - a.i AS DOUBLE) AS incidents_avoided FROM b JOIN a USING (pipeline)""")
def kpi_before_after(spark: SparkSession, d: str) -> DataFrame:
    schema = "pipeline string, score int, usd_month double, incidents double"
    return E.kpis(spark.createDataFrame(BEFORE, schema), spark.createDataFrame(AFTER, schema))


@R.query(f"""WITH {T}, {I}, tr(pipeline, has_tests, has_sla, retries, described, has_aliases) AS (VALUES {values(TRAITS)}),
g AS (SELECT DISTINCT pipeline, 0 AS o, rule AS gap FROM i WHERE category = 'observability' UNION ALL SELECT pipeline, 1, 'no deadline' FROM tr WHERE NOT has_sla
UNION ALL SELECT pipeline, 2, 'row count of ' || name FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ord) AS k FROM t WHERE access <> 'read') WHERE k <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY o, gap) AS place FROM g)
SELECT pipeline, CAST(place AS INTEGER) AS place, gap FROM r WHERE place <= 12""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage_gaps(tables(spark), issues(spark), traits(spark))


@R.query(expected('pipeline, name, "column", test', [("p1", n, col, t) for n, col, t in [("mart.sales", "id", "unique"), ("mart.sales", "id", "not_null"), ("mart.sales", "total", "not_null"), ("mart.sales", "total", "between"), ("mart.sales", "order_status", "accepted_values"), ("mart.sales", "customer_id", "relationships"), ("mart.report", "total", "not_null"), ("mart.report", "total", "between"), ("mart.report", "created_at", "not_null"), ("stg.orders", "id", "unique"), ("stg.orders", "id", "not_null"), ("stg.orders", "amount", "not_null"), ("stg.orders", "amount", "between"), ("raw.orders", "id", "unique"), ("raw.orders", "id", "not_null"), ("raw.orders", "amount", "not_null"), ("raw.orders", "amount", "between"), ("raw.customers", "id", "unique"), ("raw.customers", "id", "not_null")]]))
def generated_tests(spark: SparkSession, d: str) -> DataFrame:
    return E.generated_tests(tables(spark), lineage(spark))


TITLES = [("p1", 1, "A join has no condition"), ("p1", 2, "Join has no condition"), ("p1", 3, "All columns are selected"), ("p2", 4, "a join has no condition"), ("p1", 5, "Columns are all selected now")]


@R.query(f"""WITH t(pipeline, id, title) AS (VALUES {values(TITLES)}), w AS (SELECT DISTINCT pipeline, id, unnest(string_split(lower(title), ' ')) AS word FROM t), n AS (SELECT pipeline, id, count(*) AS n FROM w GROUP BY ALL)
SELECT x.pipeline, x.id AS a, y.id AS b, count(*) / (nx.n + ny.n - count(*)) AS overlap FROM w x JOIN w y ON x.pipeline = y.pipeline AND x.word = y.word AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY x.pipeline, x.id, y.id, nx.n, ny.n HAVING count(*) / (nx.n + ny.n - count(*)) >= 0.6""")
def review_dedup(spark: SparkSession, d: str) -> DataFrame:
    return E.similar(spark.createDataFrame(TITLES, "pipeline string, id int, title string"))


