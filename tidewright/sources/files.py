"""Writers and readers of file formats, by name: what a pipeline's READ and WRITE operations stand for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_root

#: Formats that Spark reads without further jars. avro, delta and kafka need theirs and raise Spark's own error.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, fmt: str, schema=None, **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def round_trip(df: DataFrame, fmt: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as it comes back from files of the format; it has to have one string column for text."""
    spark = df.sparkSession
    path = fresh_path(spark, fmt)
    write(df, path, fmt, partition_by=partition_by)
    return read(spark, path, fmt, None if fmt == "text" else df.schema)


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by `parts` ranges of a column at once; the driver's jar has to be there."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()
