"""Data-quality checks that run: each gives one row (check, column, rows seen, rows that fail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row(df: DataFrame, check: str, column: str, failing: Column) -> DataFrame:
    return df.agg(F.lit(check).alias("check"), F.lit(column).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(failing).alias("n_failing"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return _row(df, "not_null", column, F.col(column).isNull())


def between(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return _row(df, "between", column, bad)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return _row(df, "accepted_values", column, ~F.col(column).isin(*values))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Failing rows are those beyond the first of each key; keys with a null don't count."""
    keys = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    whole = ~F.lit(False)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return keys.agg(F.lit("unique").alias("check"), F.lit(",".join(columns)).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(whole, F.col("n") - 1)), F.lit(0)).alias("n_failing"))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose value is not null and not in the parent."""
    keys = parent.select(F.col(parent_column).alias("parent_key")).distinct().withColumn("found", F.lit(True))
    joined = child.join(keys, child[column] == keys["parent_key"], "left")
    return _row(joined, "relationships", column, F.col(column).isNotNull() & F.col("found").isNull())


def freshness(df: DataFrame, column: str, now: Column, hours: float) -> DataFrame:
    """Age of the newest row, and whether it is within the bound; an empty table is not."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max(F.col(column).cast("timestamp")))) / 3600.0
    return df.agg(F.lit("freshness").alias("check"), F.max(column).alias("newest"), age.alias("age_hours"), F.coalesce(age <= hours, F.lit(False)).alias("fresh"))


def rowcount_anomaly(df: DataFrame, column: str, trailing: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Rows a day against the mean and deviation of the days before; fewer than two days before: no verdict."""
    days = df.groupBy(F.col(column).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(-trailing, -1)  # one row a day
    days = days.withColumn("mean", F.avg("n").over(w)).withColumn("deviation", F.stddev_samp("n").over(w))
    return days.withColumn("anomalous", F.abs(F.col("n") - F.col("mean")) > sigmas * F.col("deviation"))
