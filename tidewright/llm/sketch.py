"""How common hashes are, from a sketch of fixed size over all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

SKETCH_BITS = 20
CHUNK = 1 << 14


def sketch(docs: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How often the hashes of all texts fall on each of 2^SKETCH_BITS counters, by their upper bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, many = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def add_up() -> None:
            np.add(total, np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << SKETCH_BITS), out=total)
            held.clear()

        for batch in batches:
            for some in hashes(batch.column(0)):
                held.append(some >> np.uint64(64 - SKETCH_BITS))
                many += len(some)
                if many >= 1 << SKETCH_BITS:
                    add_up()
                    many = 0
        if held:
            add_up()
        if total.any():
            parts = [total[k : k + CHUNK].astype(np.uint32).tobytes() for k in range(0, len(total), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint64)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = docs.select("text").mapInArrow(tidy(count), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for chunk, counts in parts.collect():  # 2^SKETCH_BITS counters, whatever the input
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.uint64)
    return out


def commonness(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """A class for each counter (0 for what chance explains), and the expected length of a list under a class-0 hash."""
    mean = max(float(counts.mean()), 1e-9)
    classes = np.clip(np.ceil(2 * np.log2(np.maximum(counts, 1) / (mean + 4 * mean**0.5 + 4))), 0, 255).astype(np.uint8)
    light = counts[classes == 0].astype(np.float64)
    length = float((light**2).sum() / light.sum() - mean) if light.sum() else 0.0
    return classes, max(0.0, length)


def class_of(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
