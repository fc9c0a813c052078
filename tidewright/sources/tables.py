"""Readers of the star schema and the demo warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """The tables as temporary views, for SQL text."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def _at(values: list[str], i) -> object:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def demo_warehouse(spark: SparkSession) -> dict[str, DataFrame]:
    """The six demo tables, each a formula over range(n)."""
    i = F.col("id")
    cents = lambda c: c.cast("decimal(12,2)")
    customers = spark.range(60).select(
        i.alias("customer_id"), F.concat(F.lit("user"), i.cast("string"), F.lit("@"), _at(["gmail.com", "example.com", "corp.io"], i)).alias("customer_email"),
        F.concat(F.lit("+1-555-"), F.lpad(i.cast("string"), 4, "0")).alias("customer_phone"), _at(["Paris", "London", "Berlin", "Madrid", "Rome", "Oslo"], i).alias("city"),
        F.date_add(F.lit("2022-01-01").cast("date"), (i * 3).cast("int")).alias("signup_date"),
    )
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    orders = spark.range(80).select(i.alias("order_id"), (i % 60).alias("customer_id"), _at(["complete", "pending", "cancelled", "shipped", "refunded"], i).alias("status"), cents(i * 13 % 500 + 10).alias("amount"), (start + F.make_dt_interval(hours=(i * 7).cast("int"))).alias("created_at"))
    paid = F.lit("2023-01-02 00:00:00").cast("timestamp_ntz")
    payments = spark.range(70).select(i.alias("payment_id"), (i % 80).alias("order_id"), (i % 80 % 60).alias("customer_id"), cents(i * 11 % 500 + 10).alias("amount"), _at(["USD", "EUR", "GBP", "JPY"], i).alias("currency"), (paid + F.make_dt_interval(hours=(i * 9).cast("int"))).alias("paid_at"))
    addresses = spark.range(60).select(i.alias("address_id"), i.alias("customer_id"), F.concat(i.cast("string"), F.lit(" Main Street")).alias("address_text"), F.lpad((i + 10000).cast("string"), 5, "0").alias("postal_code"))
    excluded = spark.createDataFrame([("cancelled",), ("refunded",), ("fraud",)], "status string")
    enriched = orders.join(customers, "customer_id").join(excluded, "status", "left_anti").select("order_id", "created_at", "customer_email", "amount")
    return {"raw.customers": customers, "raw.orders": orders, "raw.payments": payments, "raw.addresses": addresses, "raw.excluded_statuses": excluded, "analytics.enriched_orders": enriched}
