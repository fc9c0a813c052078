"""The 10 rules on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ..ir import Tables
from . import a, at, once, rule, yes

SFK = "spark flink kafka"


def streams(t: Tables) -> DataFrame:
    return t.pipelines.where(F.coalesce(F.col("facts")["streaming"] == "true", F.lit(False)) | F.col("format").isin("flink", "kafka")).select("pipeline", "source", "facts", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("ord"))


def lacks(df: DataFrame, t: Tables, *types: str) -> DataFrame:
    return df.join(t.ops(*types).select("pipeline").distinct(), "pipeline", "left_anti")


def of_streams(t: Tables, *types: str) -> DataFrame:
    return t.ops(*types).join(streams(t).select("pipeline"), "pipeline", "left_semi")


@rule("UNBOUNDED_STATE", "CRITICAL", "reliability", SFK, "State without an end", "Set a time to live, or a watermark.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("STATE").where(~yes("has_ttl")), "State is kept for every key that was ever seen")


@rule("MISSING_WATERMARK", "CRITICAL", "reliability", SFK, "Windows without a watermark", "Declare a watermark on the event time.")
def _(t: Tables) -> DataFrame:
    kinds = ["tumbling", "hopping", "session", "sliding", "cumulative", "cumulate", ""]
    w = once(of_streams(t, "WINDOW").where(F.coalesce(a("kind"), F.lit("")).isin(*kinds)))
    return at(lacks(w, t, "WATERMARK"), "A window on event time never knows when it is complete")


@rule("NO_CHECKPOINTING", "CRITICAL", "reliability", SFK, "No checkpoint", "Set a checkpoint location.")
def _(t: Tables) -> DataFrame:
    return at(lacks(streams(t), t, "CHECKPOINT"), "A restart loses the stream's place and state")


@rule("WIDE_TUMBLING_WINDOW", "WARNING", "performance", SFK, "A window longer than an hour", "Aggregate in short windows and add them up.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("WINDOW").where(a("size_minutes").cast("double") > 60), "The window holds %s minutes of state", a("size_minutes"))


@rule("BLOCKING_OPERATION", "WARNING", "performance", SFK, "A stream is sorted or made distinct", "Do that inside a window.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("ORDER_BY", "DISTINCT").where(yes("on_stream")), "%s needs all rows, and a stream has no last one", "type")


@rule("NO_BACKPRESSURE_HANDLING", "WARNING", "reliability", SFK, "The intake has no limit", "Limit the rows of a batch.")
def _(t: Tables) -> DataFrame:
    s = once(of_streams(t, "SOURCE")).join(streams(t).where(~F.coalesce(F.col("facts")["has_backpressure"] == "true", F.lit(False))).select("pipeline"), "pipeline", "left_semi")
    return at(s, "The source %s may hand over any backlog at once", F.coalesce(F.nullif(a("topic"), F.lit("")), a("table"), F.lit("")))


@rule("REPARTITION_SHUFFLE", "WARNING", "performance", SFK, "A stream is dealt out anew", "Partition where the data is written first.")
def _(t: Tables) -> DataFrame:
    return at(of_streams(t, "REPARTITION").where(F.coalesce(a("target_partitions").cast("int"), F.lit(0)) != 1), "%s moves every row of every batch", a("method"))


@rule("COLLECT_TO_DRIVER", "WARNING", "performance", SFK, "All rows go to the driver", "Write the result, or take a few rows.")
def _(t: Tables) -> DataFrame:
    return at(t.ops("COLLECT"), "%s() brings all rows into one process", a("method"))


@rule("SINGLE_PARTITION_SINK", "WARNING", "performance", SFK, "One task writes all", "Leave the number of partitions to Spark.")
def _(t: Tables) -> DataFrame:
    ops = t.ops("REPARTITION").where(a("target_partitions") == "1")
    spark_text = t.pipelines.where(F.col("format").isin("spark", "flink", "kafka")).select("pipeline")
    text = t.lines.where(N.contains_any(F.translate("content", " \t", ""), (".repartition(1)", ".coalesce(1)"))).join(spark_text, "pipeline", "left_semi")
    new = text.join(ops.select("pipeline", "line"), ["pipeline", "line"], "left_anti").select("pipeline", "line", F.lit(0).alias("col"), F.lit("A single partition carries all rows").alias("message"))
    return at(ops, "%s(1) makes one task write everything", a("method")).unionByName(new)


@rule("NO_CONSUMER_GROUP_NAMING", "INFO", "observability", SFK, "The consumer has no name", "Set a group id.")
def _(t: Tables) -> DataFrame:
    named = N.contains_any(N.squeezed(F.col("source")), ("groupid", "consumergroup", "applicationid"))
    s = once(of_streams(t, "SOURCE").where(F.coalesce(a("connector"), F.lit("")) == "kafka")).join(streams(t).where(named).select("pipeline"), "pipeline", "left_anti")
    return at(s, "The lag of this consumer can't be told from others'")
