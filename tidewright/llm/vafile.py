"""Exact top-k search over vector-approximation files.

Every component x becomes v = floor(64 x). Two tables are written: the exact vectors, each under a key, and the file, one row
for each block of vectors with their ids, keys, cells (one of CELLS equal cells a dimension, a byte a component), the
dimensions' edges, and each vector's distance to the middle m of its cells.

1. Scan. A task holds a block of the file and a block of queries. q * m is known from the cells alone, and the score q * v is
   no further from it than the cells' half widths times |q|, nor than |q| times the distance to the middle (Cauchy). So every
   score has a lower and an upper bound (for inner products the upper bound takes the place of a distance's lower bound). The
   k-th largest lower bound of the blocks so far is a floor: vectors whose upper bound is below it can't be among the k best.
   Blocks that meet the same queries follow each other in groups, so a query's candidates grow with groups and not with blocks.
2. Read. What is left is read in order of falling upper bound: first each query's 2 k best bounds. Their k-th exact score is
   the next floor. Only vectors whose upper bound reaches it are read after that (a tie must be, since it may have the smaller
   id); all others are certain to be worse, so the result is exact. Exact vectors are fetched by key, and only those.

Copies: rows of a block with equal id and vector are one with a count, and of equal vectors no more than k + 1 ids (the
smallest) are candidates, so copies do not widen the lists. The queries are a stated set against all rows, in blocks: every
pair of blocks is a key of its own, so no task gets more than its blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part; queries meet vectors of their own
length only; equal scores go to the smaller id; with fewer than k candidates all are returned; a query's own row (same id)
is no candidate; query rows of equal id are one query, repeated vectors are candidates each; an empty table gives no rows;
other columns are not read. Scores are exact while |score| < 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts_for, tidy
from .textfilter import rows_near

SCALE = 64
CELLS = 32
VECTORS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 4_096
QUERIES_AT_ONCE = 256
BLOCKS_PER_SALT = 64
TASKS = 8
ROWS_HELD = 1 << 20
FILE = ["dim", "ids", "keys", "times", "copy", "least", "width", "off", "cells"]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v, array<bigint> floor(SCALE * x), of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(fit)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their list in `column`: the rows' numbers and their lists as a matrix."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)].astype(np.int64) if dim else np.zeros((len(at), 0), np.int64)


def approximate(v: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n x d vectors: cells (one byte each), each dimension's least value and cell width, each vector's distance to its
    cells' middle (a little more, for rounding)."""
    least = v.min(axis=0)
    width = np.maximum(1, -(-(v.max(axis=0).astype(np.float64) - least + 1) // cells))
    cell = np.clip(np.floor((v - least) / width), 0, cells - 1)
    off = np.sqrt(((v - (least + (cell + 0.5) * width - 0.5)) ** 2).sum(axis=1))
    return cell.astype(np.uint8), least.astype(np.float64), width, off * (1 + 1e-6)


def approximation_file(exact: DataFrame) -> DataFrame:
    """One row for each block of vectors of one length (key, vec_id, v): FILE, packed."""

    def block(dim: int, keys: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, ids, *v.T))  # equal vectors beside each other, by id
        keys, ids, v = keys[order], ids[order], v[order]
        new_v = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
        first = np.flatnonzero(np.r_[True, new_v[1:] | (ids[1:] != ids[:-1])])
        times = np.diff(np.r_[first, len(ids)])
        starts = new_v[first]
        copy = np.arange(len(first)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
        cell, least, width, off = approximate(v[first])
        packed = [ids[first], keys[first], times.astype(np.int64), copy.astype(np.int32), least, width, off, cell]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=FILE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "vec_id"))
            for at, v in matrices(batch, "v"):
                dim = v.shape[1]
                own = held.setdefault(dim, [])
                own.append((keys[at], ids[at], v))
                if sum(len(x[0]) for x in own) >= VECTORS_PER_BLOCK:
                    keys_, ids_, v_ = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
                    for k in range(0, len(keys_), VECTORS_PER_BLOCK):
                        yield block(dim, keys_[k : k + VECTORS_PER_BLOCK], ids_[k : k + VECTORS_PER_BLOCK], v_[k : k + VECTORS_PER_BLOCK])
        for dim, own in held.items():
            yield block(dim, *(np.concatenate(x) for x in zip(*own, strict=True)))

    return exact.select("key", "vec_id", "v").mapInArrow(tidy(pack), "dim int, " + ", ".join(f"{c} binary" for c in FILE[1:]))


def bounds(q: np.ndarray, cell: np.ndarray, least: np.ndarray, width: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries q with vectors of which only the cells are known."""
    d = q.shape[1]
    middle = least + (cell + 0.5) * width - 0.5
    largest = float(np.abs(q).max(initial=1)) * float(np.abs(middle).max(initial=1)) * max(1, d)
    real = np.float32 if largest < 2**22 else np.float64
    centre = (q.astype(real) @ middle.astype(real).T).astype(np.float64)
    norm, box = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.abs(q).astype(np.float64) @ ((width - 1) / 2)
    slack = np.minimum(box[:, None], norm[:, None] * off[None, :]) * (1 + 1e-6) + largest * (d + 4) * float(np.finfo(real).eps)
    return centre - slack, centre + slack


def scan_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, copy: np.ndarray, best: np.ndarray, *cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of vectors that may be among the query's k best, and their upper bounds. best: each query's k
    largest lower bounds of the blocks before, -inf where there are fewer; this block's go in."""
    k = best.shape[1]
    held = np.flatnonzero(copy <= k)  # the query's own id may be one of the first k + 1
    ids, (cell, least, width, off) = ids[held], cells
    cell, off = cell[held], off[held]
    for s in range(0, len(q), QUERIES_AT_ONCE):
        lower, upper = bounds(q[s : s + QUERIES_AT_ONCE], cell, least, width, off)
        own = q_ids[s : s + QUERIES_AT_ONCE, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        need = min(k, len(ids))
        top = np.partition(lower, len(ids) - need, axis=1)[:, len(ids) - need :]
        top = np.partition(np.concatenate([best[s : s + QUERIES_AT_ONCE], top], axis=1), need, axis=1)[:, need:]
        best[s : s + QUERIES_AT_ONCE] = top
        i, j = np.nonzero((upper >= top.min(axis=1)[:, None]) & (upper > -np.inf))
        yield i + s, held[j], upper[i, j]


def candidates(file: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, key, times and upper of the scan. queries: vec_id, v."""
    n_queries, n_blocks = queries.count(), file.count()
    parts = parts_for(n_queries, QUERIES_PER_BLOCK, 1 << 30)
    salts = max(parts_for(n_blocks, BLOCKS_PER_SALT, 1 << 30), min(n_blocks, parts_for(TASKS, parts, 1 << 30)))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for at, v in matrices(batch, "v"):
                held.setdefault(v.shape[1], []).append((ids[at], v))
        for dim, own in held.items():
            packed = [np.concatenate(x).tobytes() for x in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["dim", "part", "q_ids", "q_v"])

    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(pack, "dim int, part int, q_ids binary, q_v binary")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocks = file.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(salts)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a packed row is megabytes, of which the size of its file tells little: never a broadcast, whose rows pass through the driver
    meet = blocks.join(asked.hint("merge"), ["dim", "part", "salt"]).select(*FILE, "part", "salt", "q_ids", "q_v")
    names = ["query_id", "key", "times", "upper"]

    def flush(best: np.ndarray, held: list[tuple]) -> list[tuple]:
        """What the blocks so far leave of the candidates held."""
        i, key, times, upper = (np.concatenate(x) for x in zip(*held, strict=True))
        stay = upper >= best.min(axis=1)[i]
        return [(i[stay], key[stay], times[stay], upper[stay])]

    def rows(q_ids: np.ndarray, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i, key, times, upper in held:
            for s in range(0, len(i), 1 << 16):
                cut = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[cut]]), pa.array(key[cut]), pa.array(times[cut]), pa.array(upper[cut])], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, q_ids, best, held, many = None, None, None, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                of = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)  # noqa: E731, B023
                now = dim, batch.column("part")[row].as_py(), batch.column("salt")[row].as_py()
                if now != group:  # the join is sorted by these, so blocks that meet the same queries follow each other
                    if held:
                        yield from rows(q_ids, flush(best, held))
                    group, q_ids, held, many = now, of("q_ids", np.int64).copy(), [], 0
                    best = np.full((len(q_ids), k), -np.inf)
                ids, keys, times = (of(c, np.int64) for c in ("ids", "keys", "times"))
                cells = of("cells", np.uint8).reshape(len(ids), dim), of("least", np.float64), of("width", np.float64), of("off", np.float64)
                for i, j, upper in scan_block(q_ids, of("q_v", np.int64).reshape(len(q_ids), dim), ids, of("copy", np.int32), best, *cells):
                    held.append((i, keys[j], times[j], upper))
                    many += len(i)
                    if many > ROWS_HELD:
                        held = flush(best, held)
                        many = len(held[0][0])
                        if many > ROWS_HELD // 2:  # all may still be needed
                            yield from rows(q_ids, held)
                            held, many = [], 0
        if held:
            yield from rows(q_ids, flush(best, held))

    return meet.mapInArrow(tidy(scan), "query_id long, key long, times long, upper double")


def read_exact(wanted: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, times, score of wanted (query_id, key, times): only the vectors asked for leave their place."""
    wanted = materialise(wanted, "va-wanted")
    near = rows_near(exact, "key", wanted.select("key"))
    both = near.join(wanted, "key").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).hint("merge"), "query_id").select("query_id", "vec_id", "times", "v", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows, np.int64)
            for (at, v), (_, q) in zip(matrices(batch, "v"), matrices(batch, "q"), strict=True):
                score[at] = (v * q).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["query_id", "vec_id", "times", "score"])

    return materialise(both.mapInArrow(tidy(run), "query_id long, vec_id long, times long, score long"), "va-scores")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest integer inner product with each query. counts, if given, gets
    how many scores were bounded as candidates and how many exact vectors were read for them."""
    exact = materialise(usable(vectors, id_col, vec_col).withColumn("key", F.monotonically_increasing_id()), "va-exact")  # written once, so the keys stay
    file = materialise(approximation_file(exact), "va-file")
    asked = materialise(usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")), "va-queries")
    found = materialise(candidates(file, asked, k), "va-candidates")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key")
    first = materialise(found.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= 2 * k), "va-first")
    scores = read_exact(first.select("query_id", "key", "times"), exact, asked)
    kth = scores.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("kth"))  # of 2 k scores a query
    last = first.where(F.col("place") == 2 * k).select("query_id", F.col("upper").alias("last_upper"), F.col("key").alias("last_key"))
    later = (F.col("upper") < F.col("last_upper")) | ((F.col("upper") == F.col("last_upper")) & (F.col("key") > F.col("last_key")))
    rest = found.join(last, "query_id").where(later).join(kth, "query_id").where(F.col("upper") >= F.col("kth")).select("query_id", "key", "times")
    scores = scores.union(read_exact(rest, exact, asked))
    if counts is not None:
        counts |= {"candidates": found.count(), "read": scores.count()}
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)  # a row or more each, so k rows are enough
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
