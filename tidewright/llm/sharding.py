"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is a vector of K sums. Differencing takes the two partial partitions with the largest spread (largest
sum minus smallest), adds them in opposite order and puts the result back, until one is left.

Scale: the groups come from a combining aggregation over text digests, so a group of copies of any size is one row. The
groups are dealt into buckets by digest; each bucket is differenced on its own in one task, which leaves one partial
partition a bucket. These are differenced in turn, FAN at once in a task, level by level until one is left, so no task holds
more than GROUPS_PER_BUCKET groups or FAN partial partitions and nothing comes to the driver. Slots are numbered inside chunks
of a shard with offsets from the chunks' counts, so no window spans a shard.

Defined cases: a null text counts as no bytes (size 8) and groups with empty texts, crc32 0; repeated rows are rows of
their own and share their group's shard; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_for

SHARDS = 24
GROUPS_PER_BUCKET = 2_048
FAN = 256
ROWS_PER_CHUNK = 50_000
ROW_OVERHEAD = 8


def difference(vectors: np.ndarray) -> np.ndarray:
    """vectors: n x k sums of n partial partitions. Returns n x k: where each vector's j-th part goes, 0 to k - 1."""
    n, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    heap = [(-int(v[o[0]] - v[o[-1]]), i) for i, (v, o) in enumerate(zip(vectors, order, strict=True))]
    sums = {i: vectors[i][order[i]] for i in range(n)}  # largest first
    made: list[tuple[int, int, np.ndarray]] = []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        to = np.argsort(-both, kind="stable")
        at = n + len(made)
        made.append((a, b, to))
        sums[at] = both = both[to]
        heapq.heappush(heap, (-int(both[0] - both[-1]), at))
    place = {n + len(made) - 1 if made else 0: np.arange(k)}  # of the sorted sums of each node
    for at in range(n + len(made) - 1, n - 1, -1):
        a, b, to = made[at - n]
        here = np.empty(k, dtype=np.int64)
        here[to] = place.pop(at)  # of the sums before they were sorted
        place[a], place[b] = here, here[::-1]
    out = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def _difference_singles(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part of each of n single groups. The same differencing, with all-but-one sums zero at the start."""
    vectors = np.zeros((len(sizes), k), dtype=np.int64)
    vectors[:, 0] = sizes
    return difference(vectors)[:, 0]


def levels(sums: DataFrame, buckets: int, k: int, fan: int = FAN) -> DataFrame:
    """bucket, part, shard for all k parts of every bucket. sums: bucket, part, bytes of the parts that hold something."""

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here = np.sort(pdf["bucket"].unique())
        vectors = np.zeros((len(here), k), dtype=np.int64)
        vectors[np.searchsorted(here, pdf["bucket"]), pdf["part"]] = pdf["bytes"]
        to = difference(vectors)
        return pd.DataFrame({"bucket": np.repeat(here, k), "part": np.tile(np.arange(k), len(here)), "parent": int(key[0]), "to": to.ravel(), "bytes": vectors.ravel()})

    place = None
    while True:
        parent = F.floor(F.col("bucket") / fan).cast("int").alias("parent")
        made = sums.withColumn("parent", parent).groupBy("parent").applyInPandas(step, "bucket int, part int, parent int, to int, bytes long")
        made = materialise(made, "sharding-level")
        if place is None:
            place = made.select("bucket", "part", F.col("parent").alias("at"), F.col("to").alias("shard"))
        else:
            up = made.select(F.col("bucket").alias("at"), F.col("part").alias("shard"), F.col("parent").alias("next_at"), "to")
            place = place.join(up, ["at", "shard"]).select("bucket", "part", F.col("next_at").alias("at"), F.col("to").alias("shard"))
        buckets = -(-buckets // fan)
        if buckets <= 1:
            return place.select("bucket", "part", "shard")
        sums = made.groupBy(F.col("parent").alias("bucket"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = ROW_OVERHEAD, groups_per_bucket: int = GROUPS_PER_BUCKET, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = docs.count()
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("digest"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + overhead).cast("long").alias("size"))
    slim = materialise(slim, "sharding-rows")
    group = ["digest", "text_crc32", "size"]
    buckets = parts_for(rows, groups_per_bucket, 1 << 30)
    groups = slim.groupBy(*group).agg((F.count(F.lit(1)) * F.col("size")).alias("bytes")).withColumn("bucket", F.pmod("digest", F.lit(buckets)).cast("int"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", *group], ascending=[False, True, True, True])
        return pdf.assign(part=_difference_singles(pdf["bytes"].to_numpy(), n_shards).astype("int32"))

    placed = groups.groupBy("bucket").applyInPandas(local, "digest long, text_crc32 long, size long, bytes long, bucket int, part int")
    placed = materialise(placed, "sharding-groups")
    sums = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    placed = placed.join(levels(sums, buckets, n_shards, fan), ["bucket", "part"]).select(*group, "shard")
    out = slim.join(placed, group)
    chunk = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(max(8, parts_for(rows, n_shards * ROWS_PER_CHUNK, 1_000_000)))).cast("int")
    out = out.withColumn("chunk", chunk)
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_chunk = Window.partitionBy("shard", "chunk").orderBy("doc_id", "digest")
    out = out.withColumn("row", F.row_number().over(in_chunk)).join(offsets, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"))


def spread(sharded: DataFrame) -> DataFrame:
    """Bytes and rows of each shard."""
    return sharded.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


