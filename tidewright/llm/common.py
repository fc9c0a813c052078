"""What several operators share: word rules and readers."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise, passing, ship

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
__all__ = ["SPACE_CLASS", "WORD_CLASS", "discard", "materialise", "parts_for", "passing", "release", "shield", "table", "tidy", "word_count", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, a function over batches, with a release at its task's end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def shield(df: DataFrame, *names: str):
    """df with its columns of these names renamed out of the way, and what gives a result df's own columns back."""
    away = {c: f"{c}__own" for c in df.columns if c in names}
    return df.withColumnsRenamed(away), lambda out: out.select(*[F.col(away.get(c, c)).alias(c) for c in df.columns])


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_CLASS, "w")
    return (F.length(t) - F.length(F.regexp_replace(t, "w", ""))).cast("long")


def parts_for(rows: int, each: int, most: int) -> int:
    """How many parts hold `rows` rows at about `each` a part; between 1 and `most`."""
    return int(min(most, max(1, math.ceil(rows / each))))
