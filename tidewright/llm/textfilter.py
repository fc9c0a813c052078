"""Reading some rows of a table without dealing out all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

FILTER_BITS = 1 << 23


def bits_of(df: DataFrame, hashed: Column) -> np.ndarray:
    """A filter of FILTER_BITS bits with those at `hashed` modulo FILTER_BITS set, as 64-bit words."""
    word = F.pmod(hashed, F.lit(FILTER_BITS))
    bits = df.select(word.alias("word")).select(F.shiftright("word", 6).cast("int").alias("at"), F.expr("shiftleft(1L, int(word % 64))").alias("bit"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for at, x in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas().itertuples(index=False):  # FILTER_BITS / 64 rows at most
        filled[at] = x
    return filled.view(np.uint64)


def rows_near(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Every row of `rows` whose `column` is in `wanted` (one column of that name), and few others: a bit filter of fixed size
    (FILTER_BITS, so its broadcast never grows) is tested where the rows are read. A join must follow."""
    shared = rows.sparkSession.sparkContext.broadcast(bits_of(wanted, F.xxhash64(column)))
    own_columns = rows.columns

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (own[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(own_columns).filter(pa.array(hit.astype(bool)))

    keyed = rows.where(F.col(column).isNotNull())
    return keyed.withColumn("filter_word", F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))).mapInArrow(tidy(near), keyed.schema)


def texts_near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose doc_id is in ids (one column, doc_id), and of few others."""
    return rows_near(docs.select("doc_id", "text"), "doc_id", ids)
