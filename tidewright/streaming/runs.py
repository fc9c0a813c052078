"""Streams over files, run until their input is used up; for tests, backfills and comparison with batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root, ship


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The table's Parquet as a stream; files_per_trigger bounds a batch."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = path[:-1] + "[t]"  # a pattern, since a stream takes a single file no other way
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _checkpoint(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"


def drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there now, each batch into a folder of its own that a batch run again overwrites. In
    complete mode the last batch holds everything, else the batches add up."""
    checkpoint = _checkpoint(spark)
    out = f"{checkpoint}-out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # no input, so no batch ran
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def running_totals(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """user_id, n and total from state kept per user (count, cents); every batch gives the user's new totals, the last wins."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, cents = state.get if state.exists else (0, 0)
        for pdf in batches:
            n, cents = n + len(pdf), cents + int((pdf["value"] * 100).round().sum())
        state.update((n, cents))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [cents / 100.0]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    ship(spark)

    out = stream.select("user_id", "value").groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, total double", "n long, cents long", "update", GroupStateTimeout.NoTimeout)
    all_rows = drain(spark, out, "update")
    return all_rows.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("x")).select("user_id", "x.n", "x.total")
