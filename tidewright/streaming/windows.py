"""Event-time windows for batch and stream, and batch forms of what only streams have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP; a watermark needs that, and the session's time zone is UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumble(df: DataFrame, column: str, size: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(F.window(column, size).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in _names(aggs)])


def hop(df: DataFrame, column: str, size: str, slide: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(F.window(column, size, slide).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *_names(aggs))


def session(df: DataFrame, column: str, gap: str, keys: list[str], *aggs: Column) -> DataFrame:
    """An event exactly `gap` after the one before still belongs to its session's successor interval [start, last + gap)."""
    return df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *_names(aggs))


def cumulate(df: DataFrame, column: str, step_minutes: int, size_minutes: int, keys: list[str], *aggs: Column) -> DataFrame:
    """Windows that grow by a step up to the size: aggregated by step first, then each step's row counts for the windows
    that hold it. aggs are over the rows; those of the steps are added, so they must be sums or counts."""
    n = size_minutes // step_minutes
    step = tumble(df, column, f"{step_minutes} minutes", keys, *aggs)
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("window_start") / (size_minutes * 60)) * (size_minutes * 60))
    step = step.withColumn("big", start).withColumn("k", ((F.unix_timestamp("window_start") - F.unix_timestamp("big")) / (step_minutes * 60) + 1).cast("int"))
    grown = step.withColumn("upto", F.explode(F.sequence(F.col("k"), F.lit(n))))
    out = grown.groupBy("big", "upto", *keys).agg(*[F.sum(c).alias(c) for c in _names(aggs)])
    end = F.timestamp_seconds(F.unix_timestamp("big") + F.col("upto") * step_minutes * 60)
    return out.select(F.col("big").alias("window_start"), end.alias("window_end"), *keys, *_names(aggs))


def drop_late(df: DataFrame, order: str, column: str, delay: str, rows_per_part: int = 500_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """What a stream that sees the rows in `order` (a whole number; nulls last) keeps: those not older than the newest seen
    before, less the delay. Rows of equal `order` are seen in the order of the columns `ties`; reruns agree if these tell all
    rows apart. The running maximum is taken inside ranges of the order, over a prefix maximum of the ranges before."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return df
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // rows_per_part))))
    after = (high - low) // width + 1  # the part of the nulls
    df = df.withColumn("late_part", F.coalesce(F.floor((F.col(order) - F.lit(low)) / F.lit(width)), F.lit(after)))
    parts = df.groupBy("late_part").agg(F.max(column).alias("part_newest"))
    earlier = F.max("part_newest").over(Window.orderBy("late_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    parts = parts.select("late_part", earlier.alias("newest_before"))
    seen = [F.asc_nulls_last(k) for k in (order, *ties)]
    inside = F.max(column).over(Window.partitionBy("late_part").orderBy(*seen).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("newest_inside", inside).join(parts, "late_part").withColumn("newest", F.greatest("newest_inside", "newest_before"))
    kept = df.where(F.col("newest").isNull() | (F.col(column) >= F.col("newest") - F.expr(f"INTERVAL {delay}")))
    return kept.drop("late_part", "newest_inside", "newest_before", "newest")


def first_within(df: DataFrame, keys: list[str], column: str, tie: str, gap_seconds: int) -> DataFrame:
    """Rows with no row of the same keys in the gap before them (dedup within a watermark, for ordered input)."""
    before = F.lag(F.unix_micros(column)).over(Window.partitionBy(*keys).orderBy(column, tie))
    return df.withColumn("before", before).where(F.col("before").isNull() | (F.unix_micros(column) - F.col("before") > gap_seconds * 1_000_000)).drop("before")


def _names(aggs: tuple[Column, ...]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in aggs]
