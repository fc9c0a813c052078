"""Streaming windows (batch forms and real streams), data quality and security queries, each with its SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import security as S
from ..operators import quality as Q
from ..sources import catalog
from ..sources.tables import read
from ..streaming import runs, windows as W
from .registry import Registry

R = Registry()
c = F.col


def events(spark: SparkSession, d: str) -> DataFrame:
    return W.event_time(read(spark, d, "events"))


def naive(df: DataFrame) -> DataFrame:
    return df.withColumns({k: c(k).cast("timestamp_ntz") for k in ("window_start", "window_end")})


def n_events():
    return F.count(F.lit(1)).alias("n")


def floor_ts(minutes: int, column: str = "ts") -> str:
    s = minutes * 60
    return f"CAST(make_timestamp(CAST(floor(epoch({column}) / {s}) * {s} AS BIGINT) * 1000000) AS TIMESTAMP)"


TUMBLE = f"SELECT {floor_ts(120)} AS window_start, {floor_ts(120)} + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"
HOP = f"""SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, {floor_ts(15)} - INTERVAL (15 * k) MINUTE AS s FROM events, unnest(range(4)) AS t(k)) GROUP BY ALL"""
SESSION = """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
CUMULATE = f"""SELECT b AS window_start, b + INTERVAL (30 * j) MINUTE AS window_end, event_type, count(*) AS n FROM (SELECT ts, event_type, {floor_ts(120)} AS b FROM events), unnest(range(1, 5)) AS t(j) WHERE ts < b + INTERVAL (30 * j) MINUTE GROUP BY ALL"""


@R.query(TUMBLE)
def win_tumble_2h(spark: SparkSession, d: str) -> DataFrame:
    return naive(W.tumble(events(spark, d), "ts", "2 hours", ["event_type"], n_events()))


@R.query(HOP)
def win_hop_1h_15m(spark: SparkSession, d: str) -> DataFrame:
    return naive(W.hop(events(spark, d), "ts", "1 hour", "15 minutes", ["event_type"], n_events()))


@R.query(SESSION)
def win_session_30m(spark: SparkSession, d: str) -> DataFrame:
    return naive(W.session(events(spark, d), "ts", "30 minutes", ["user_id"], n_events()))


@R.query(CUMULATE)
def win_cumulate(spark: SparkSession, d: str) -> DataFrame:
    return naive(W.cumulate(events(spark, d), "ts", 30, 120, ["event_type"], n_events()))


@R.query("""WITH s AS (SELECT event_id, ts, event_id * 7919 % 10007 AS arrival FROM events), m AS (SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s)
SELECT event_id, ts FROM m WHERE newest IS NULL OR ts >= newest - INTERVAL 72 HOUR""")
def late_data_drop(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts", (c("event_id") * 7919 % 10007).alias("arrival"))
    return W.drop_late(e, "arrival", "ts", "72 HOURS", ties=("event_id",)).drop("arrival")  # the SQL leaves equal arrivals open


@R.query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR""")
def dedup_within_watermark(spark: SparkSession, d: str) -> DataFrame:
    return W.first_within(events(spark, d), ["user_id", "event_type"], "ts", "event_id", 6 * 3600).select("event_id", "user_id", "event_type")


@R.query(TUMBLE)
def stream_tumble_update(spark: SparkSession, d: str) -> DataFrame:
    """A real stream over the file, in complete mode, run until its input is used up."""
    out = runs.drain(spark, W.tumble(W.event_time(runs.stream_table(spark, d, "events")).withWatermark("ts", "10 minutes"), "ts", "2 hours", ["event_type"], n_events()), "complete")
    return naive(out)


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = runs.stream_table(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return runs.drain(spark, s, "append")


@R.query(SESSION)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    s = W.event_time(runs.stream_table(spark, d, "events")).withWatermark("ts", "1 hour")
    return naive(runs.drain(spark, W.session(s, "ts", "30 minutes", ["user_id"], n_events()), "complete"))


@R.query("SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id")
def stream_custom_state(spark: SparkSession, d: str) -> DataFrame:
    """Running totals in state of our own, each row replacing the user's last."""
    return runs.running_totals(spark, runs.stream_table(spark, d, "events", 1))


@R.query("SELECT event_id, r_name FROM events JOIN region ON user_id % 5 = r_regionkey WHERE event_type = 'purchase'")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    s = runs.stream_table(spark, d, "events").where("event_type = 'purchase'")
    return runs.drain(spark, s.join(F.broadcast(read(spark, d, "region")), c("user_id") % 5 == c("r_regionkey")).select("event_id", "r_name"), "append")


VIEW_TO_PURCHASE = "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR"


@R.query(VIEW_TO_PURCHASE)
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows meet by user and hour bin, never all of a user's."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    e = events(spark, d)
    v = e.where("event_type = 'view'").select("user_id", c("event_id").alias("view_id"), c("ts").alias("seen"), F.explode(F.array(hour, hour + 1)).alias("bin"))
    p = e.where("event_type = 'purchase'").select("user_id", c("event_id").alias("purchase_id"), "ts", hour.alias("bin"))
    return v.join(p, ["user_id", "bin"]).where((c("ts") >= c("seen")) & (c("ts") <= c("seen") + F.expr("INTERVAL 1 HOUR"))).select("view_id", "purchase_id")


@R.query(VIEW_TO_PURCHASE)
def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Two streams; with both watermarks and the interval, state older than an hour and the delay is dropped."""
    late = lambda kind, name, ts: W.event_time(runs.stream_table(spark, d, "events", 1)).where(c("event_type") == kind).select("user_id", c("event_id").alias(name), c("ts").alias(ts)).withWatermark(ts, "2 hours")
    v, p = late("view", "view_id", "seen"), late("purchase", "purchase_id", "bought").withColumnRenamed("user_id", "buyer")
    meets = (c("user_id") == c("buyer")) & (c("bought") >= c("seen")) & (c("bought") <= c("seen") + F.expr("INTERVAL 1 HOUR"))
    return runs.drain(spark, v.join(p, meets).select("view_id", "purchase_id"), "append")


# ---- quality


def dq(check: str, column: str, table: str, failing: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {failing}) AS n_failing FROM {table}"


@R.query(dq("not_null", "seg", "(SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)", "seg IS NULL"))
def dq_not_null(spark: SparkSession, d: str) -> DataFrame:
    return Q.not_null(read(spark, d, "customer").select(F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("seg")), "seg")


@R.query("SELECT 'unique' AS \"check\", 'l_orderkey,l_linenumber' AS \"column\", count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_failing FROM lineitem")
def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return Q.unique(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.query(dq("accepted_values", "o_orderstatus", "orders", "o_orderstatus NOT IN ('O', 'F')"))
def dq_accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return Q.accepted_values(read(spark, d, "orders"), "o_orderstatus", ["O", "F"])


@R.query(dq("relationships", "o_custkey", "(SELECT * FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7) ON o_custkey = c_custkey)", "c_custkey IS NULL"))
def dq_relationships(spark: SparkSession, d: str) -> DataFrame:
    return Q.relationships(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer").where("c_nationkey <> 7"), "c_custkey")


@R.query(dq("between", "c_acctbal", "customer", "c_acctbal < 0"))
def dq_between(spark: SparkSession, d: str) -> DataFrame:
    return Q.between(read(spark, d, "customer"), "c_acctbal", low=0)


@R.query("SELECT 'freshness' AS \"check\", max(ts) AS newest, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) AS DOUBLE) / 3600 AS age_hours, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 3600 <= 48 AS fresh FROM events")
def dq_freshness(spark: SparkSession, d: str) -> DataFrame:
    return Q.freshness(read(spark, d, "events"), "ts", F.lit("2024-02-01").cast("timestamp"), 48)


@R.query("""WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, avg(n) OVER t AS mean, stddev_samp(n) OVER t AS deviation FROM n WINDOW t AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT day, n, round(mean, 4) AS mean, round(deviation, 4) AS deviation, abs(n - mean) > 3.0 * deviation AS anomalous FROM w""")
def dq_rowcount_anomaly(spark: SparkSession, d: str) -> DataFrame:
    out = Q.rowcount_anomaly(read(spark, d, "events"), "ts")
    return out.withColumns({k: F.round(k, 4) for k in ("mean", "deviation")})


# ---- security

NAMES = ["customer_email", "customerPhone", "ssn_hash", "SSN", "card_number", "ship_address", "ip", "zipcode", "order_id", "user-dob", "email_masked", "latitude", "description", "cc_num", "FirstName", "pwd", "tax_id", "skip_list", "iban_md5", "gender"]


def pii_case(column: str) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '(^|_)({names})(_|$)') THEN '{kind}'" for kind, _, names in S.PII_TYPES)


def _snake_sql(column: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({column}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"


PROTECTED_SQL = "list_has_any(string_split(s, '_'), [" + ", ".join(f"'{p}'" for p in S.PROTECTED) + "])"


@R.query(f"""WITH n AS (SELECT unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS name), s AS (SELECT name, {_snake_sql("name")} AS s FROM n), t AS (SELECT name, CASE WHEN {PROTECTED_SQL} THEN NULL ELSE CASE {pii_case("s")} END END AS pii_type FROM s)
SELECT name, pii_type, CASE {" ".join(f"WHEN pii_type = '{k}' THEN CAST({v} AS DOUBLE)" for k, v, _ in S.PII_TYPES)} END AS confidence FROM t""")
def pii_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string").withColumn("pii_type", S.pii_type(c("name"))).withColumn("confidence", S.pii_confidence(c("pii_type")))


@R.query(f"""WITH n AS (SELECT table_name, column_name, {_snake_sql("column_name")} AS s FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in catalog.TABLES)}))
SELECT table_name, column_name, CASE WHEN {PROTECTED_SQL} THEN NULL ELSE CASE {pii_case("s")} END END AS pii_type FROM n""")
def pii_columns_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.columns(spark, d).select("table_name", "column_name", S.pii_type(c("column_name")).alias("pii_type"))


_NAME = "[a-z0-9_]*(?:password|passwd|pwd|secret|api_?key|access_?key|auth_?token|token|private_?key|credential)[a-z0-9_]*"


@R.query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT doc_id, line, CASE WHEN regexp_matches(content, '(?i)\b{_NAME}\s*[:=]\s*["''][^"''\s]{{6,}}["'']') THEN 'assignment' END AS kind FROM l
UNION ALL SELECT doc_id, line, CASE WHEN regexp_matches(content, '\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b') THEN 'aws_key' END FROM l
UNION ALL SELECT doc_id, line, CASE WHEN regexp_matches(content, '(?i)\b[a-z][a-z0-9+.\-]*://[^/\s:@"'']+:[^/\s:@"'']+@') THEN 'url' END FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, kind FROM k WHERE kind IS NOT NULL""")
def secrets_in_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.secrets(read(spark, d, "documents"), "doc_id", "text")


@R.query(r"SELECT c_custkey, regexp_replace('user' || c_custkey || '@example.com', '^(.)[^@]*@', '\1***@') AS email, regexp_replace('+1-555-', '[A-Za-z0-9]', '*', 'g') || right(lpad(CAST(c_custkey AS VARCHAR), 4, '0'), 4) AS phone, sha256(c_name) AS name_hash, md5(c_name) AS name_md5 FROM customer")
def mask_columns(spark: SparkSession, d: str) -> DataFrame:
    key = c("c_custkey").cast("string")
    phone = F.concat(F.lit("+1-555-"), F.lpad(key, 4, "0"))
    return read(spark, d, "customer").select("c_custkey", S.mask_email(F.concat(F.lit("user"), key, F.lit("@example.com"))).alias("email"), S.mask_tail(phone).alias("phone"), F.sha2("c_name", 256).alias("name_hash"), F.md5(c("c_name").cast("binary")).alias("name_md5"))


PATHS = ["s3://warehouse/dim_pages", "s3://open-data/public/x", "gs://everyone-bucket/a", "s3a://private/b", "https://public.example.com", "abfss://world@acct/x"]
GRANTS = ["GRANT ALL ON t TO bob", "grant select on t to public", "GRANT SELECT ON t TO role_x", "REVOKE ALL ON t FROM bob", "-- grant\nGRANT USAGE ON s\nTO PUBLIC;"]


def texts(values: list[str]) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in enumerate(values))


@R.query(rf"SELECT id, regexp_matches(t, '(?i)\b(?:s3a?|gs|gcs|wasbs?|abfss?|azure|hdfs)://[^\s)]*(?:public|opendata|open-data|world|anonymous|everyone)') AS is_public FROM (VALUES {texts(PATHS)}) AS v(id, t)")
def public_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PATHS)), "id int, t string").select("id", c("t").rlike(S.PUBLIC_PATH).alias("is_public"))


@R.query(rf"SELECT id, regexp_matches(t, '(?is)\bGRANT\s+ALL\b|\bGRANT\b[^;]{{0,300}}?\bTO\s+PUBLIC\b') AS broad FROM (VALUES {texts(GRANTS)}) AS v(id, t)")
def grant_scan(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GRANTS)), "id int, t string").select("id", c("t").rlike(S.BROAD_GRANT).alias("broad"))


# ---- live lens


@R.query("SELECT table_name, count(*) AS n_columns FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in catalog.TABLES) + ") GROUP BY table_name")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return catalog.columns(spark, d).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))


@R.query("SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in catalog.TABLES) + ")")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.columns(spark, d).select("table_name", "column_name", "position")


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in catalog.TABLES))
def catalog_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.row_counts(spark, d)


@R.query("SELECT 'SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000' AS query, true AS allowed, (SELECT 1) AS rows_produced")
def profile_query(spark: SparkSession, d: str) -> DataFrame:
    catalog.register_all(spark, d)
    return catalog.profile(spark, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000").select("query", "allowed", c("rows_produced").cast("int").alias("rows_produced"))


