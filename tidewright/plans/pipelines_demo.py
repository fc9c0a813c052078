"""Small pipelines of every format, written for the registered queries and the tests."""

from __future__ import annotations

SHOP_MART = """-- nightly mart of web shop baskets
CREATE OR REPLACE TABLE shop.basket_mart AS
SELECT
    b.*,
    u.customer_email,
    (
        SELECT COUNT(*)
        FROM shop.basket_lines bl
        WHERE bl.basket_id = b.basket_id
    ) AS n_lines
FROM shop.baskets b,
     shop.shoppers u
WHERE b.opened_on >= '2024-05-01'
  AND u.customer_email LIKE '%@shop.test'
  AND b.shopper_id NOT IN (
        SELECT g.shopper_id
        FROM shop.ghosts g
  );
"""

CLEAN_REPORT = """SELECT r.region_name, SUM(s.net_value) AS net_value
FROM sales.invoice_lines s
JOIN sales.regions r ON r.region_id = s.region_id
WHERE s.event_date = DATE '2024-01-31'
GROUP BY r.region_name
LIMIT 100
"""

MESSY_SQL = """with recent as (select id, amount from pay.transactions where created_at > '2024-01-01'),
     never as (select 1 as one)
SELECT DISTINCT *
FROM recent a
LEFT JOIN pay.accounts acc ON CAST(a.id AS VARCHAR) = acc.account_key
JOIN pay.accounts acc2 ON acc2.balance > a.amount
WHERE a.kind = 'x' OR a.kind = 'y' OR upper(a.note) = 'Z'
  AND a.closed_on = NULL
  AND a.label LIKE 'plain'
UNION
SELECT id, amount FROM pay.archive ORDER BY 1;
DELETE FROM pay.scratch;
UPDATE pay.accounts SET balance = 0;
INSERT INTO pay.totals SELECT CASE WHEN amount > 0 THEN 1 END, rank() over (order by amount) FROM pay.transactions group by 1 having amount > 3;
"""

FCT_SALES = """{{ config(materialized='incremental') }}

SELECT s.sale_id, s.sold_at, c.client_id, s.net_value
FROM {{ source('till', 'sales') }} s
JOIN {{ ref('stg_clients') }} c ON c.client_id = s.client_id
WHERE s.state = 'closed'

--- schema.yml
version: 2
sources:
  - name: till
    tables:
      - name: sales
models:
  - name: fct_sales
    columns:
      - name: sale_id
      - name: net_value
"""

PAGE_VIEWS = """CREATE TABLE views (
    visitor BIGINT,
    page STRING,
    seen_at TIMESTAMP(3)
) WITH ('connector' = 'kafka', 'topic' = 'views', 'format' = 'json');

CREATE TABLE views_by_page (bucket TIMESTAMP(3), page STRING, n BIGINT) WITH ('connector' = 'kafka', 'topic' = 'views_by_page');

INSERT INTO views_by_page (bucket, page, n)
SELECT TUMBLE_START(seen_at, INTERVAL '3' HOUR), page, COUNT(*) AS n
FROM views
GROUP BY TUMBLE(seen_at, INTERVAL '3' HOUR), page
ORDER BY n DESC;
"""

NIGHTLY_DAG = '''from datetime import datetime

from airflow import DAG
from airflow.operators.python import PythonOperator
from airflow.providers.apache.spark.operators.spark_submit import SparkSubmitOperator
from airflow.sensors.filesystem import FileSensor


def pull(**context):
    frame_df = load()
    context["ti"].xcom_push(key="rows", value=frame_df.to_dict())


with DAG(dag_id="nightly_sales", start_date=datetime(2024, 1, 1), schedule_interval="@daily", default_args={"retries": 0}) as dag:
    wait = FileSensor(task_id="wait_for_file", filepath="/in/sales.csv", poke_interval=120)
    first = PythonOperator(task_id="pull_sales", python_callable=pull)
    clean = SparkSubmitOperator(task_id="spark_clean", application="clean.py")
    total = SparkSubmitOperator(task_id="spark_total", application="total.py")
    wait >> first >> clean >> total
'''

LEAKY_JOB = '''from pyspark.sql import SparkSession

spark = SparkSession.builder.appName("leaky").getOrCreate()
db_password = "hunter2hunter2"
rates = spark.read.csv("s3://open-data-public/rates.csv")
rates.coalesce(1).write.mode("overwrite").parquet("s3://own/rates")
'''

STREAM_JOB = '''from pyspark.sql import SparkSession, functions as F

spark = SparkSession.builder.getOrCreate()
taps = spark.readStream.format("kafka").option("subscribe", "taps").load()
counts = taps.withWatermark("at", "10 minutes").groupBy(F.window("at", "5 minutes")).count()
counts.writeStream.option("checkpointLocation", "s3://own/ck").outputMode("append").start("s3://own/counts")
'''

FLOW = '''from prefect import flow, task


@task(retries=2, retry_delay_seconds=30)
def fetch():
    return 1


@task
def spark_load(x):
    return x


@flow(name="hourly")
def hourly():
    """Hourly load."""
    x = fetch()
    spark_load(x)
'''

CONSUMER = '''from kafka import KafkaConsumer, KafkaProducer

consumer = KafkaConsumer("orders", bootstrap_servers="b:9092", group_id="billing")
producer = KafkaProducer(bootstrap_servers="b:9092")
for m in consumer:
    producer.send("invoices", m.value)
'''

TOPOLOGY = """StreamsBuilder builder = new StreamsBuilder();
builder.stream("clicks")
    .groupByKey()
    .windowedBy(TimeWindows.of(Duration.ofMinutes(90)))
    .count()
    .toStream()
    .to("click_counts");
"""

SUITE = """{"expectation_suite_name": "sales.warning", "expectations": [
  {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "sale_id"}},
  {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "net_value", "min_value": 0}}]}
"""

TEXTS = {
    "shop_mart": SHOP_MART, "clean_report": CLEAN_REPORT, "messy_sql": MESSY_SQL, "fct_sales": FCT_SALES, "page_views": PAGE_VIEWS, "nightly_dag": NIGHTLY_DAG,
    "leaky_job": LEAKY_JOB, "stream_job": STREAM_JOB, "flow": FLOW, "consumer": CONSUMER, "topology": TOPOLOGY, "suite": SUITE, "garbage": "!!! no pipeline at all !!!",
}

OPERATIONS_JOB = '''from pyspark.sql import SparkSession, Window, functions as F

spark = SparkSession.builder.getOrCreate()
sales = spark.read.parquet("s3://own/sales")
shops = spark.read.table("ref.shops")
goods = spark.read.json("s3://own/goods")
joined = sales.join(F.broadcast(shops), "shop_id").join(goods, "good_id").filter("v > 0")
by_shop = joined.groupBy("shop_id").agg(F.sum("v").alias("v"))
ranked = by_shop.withColumn("r", F.rank().over(Window.partitionBy("shop_id").orderBy("v"))).repartition(8).cache()
rows = ranked.collect()
ranked.write.parquet("s3://own/ranked")
'''

OPERATIONS_LOOP = '''from airflow import DAG
from airflow.operators.python import PythonOperator

with DAG(dag_id="by_shop", schedule="@hourly") as dag:
    for shop in SHOPS:
        PythonOperator(task_id="load_shop", python_callable=load)
'''

OPERATIONS_MERGE = """MERGE INTO pay.accounts AS a USING pay.changes AS c ON a.id = c.id
WHEN MATCHED THEN UPDATE SET balance = c.balance WHEN NOT MATCHED THEN INSERT (id, balance) VALUES (c.id, c.balance)
"""

#: For the kinds of operations that no text above has.
OPERATION_TEXTS = {"operations_job": OPERATIONS_JOB, "operations_loop": OPERATIONS_LOOP, "operations_merge": OPERATIONS_MERGE}
